"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key-like characters with a digit in it or with letters that change case often, a value
given to a name such as `password`, the password of a connection string, or a block that holds a private key. The
forest judges it by its length, its character transitions, how far dictionary words cover it, the path of its document
and the words around it. It is trained from labelled findings (Finding); `labelled_findings` makes a seeded set of at
most `n` (a bounded sample, 4,000 in production) after public formats of keys and of what is mistaken for them, for use
where a project has none of its own.

Defined cases: null and empty texts have no candidate; a null path counts as an empty one; repeated rows are scanned
each; texts of any length are scanned whole; candidates that overlap are one; a score that ties with the limit counts as
a secret; an empty table gives no rows; columns that have a result's name are replaced, no other name can clash.
"""

from __future__ import annotations

import base64
import functools
import math
import pickle
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import forest
from driftline.llm.common import ids_of, numbered_columns, own_arrays, own_fields, slices

LONG = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
GIVEN = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential)s?[\"']?\s*(?:[:=]|=>|:=)\s*[\"']?([^\s\"'`,;]{6,})")
#: The password in scheme://user:password@host.
LOGIN = re.compile(r"://[^\s/:@\"']*:([^\s/@\"']{6,})@")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*-----END (?:[A-Z]+ )*PRIVATE KEY-----")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
MARK = "<SECRET>"
#: A common vocabulary; what is made of such words is seldom a key.
WORDS = frozenset("""about above access account action active address admin after again align alpha amount apache application archive array assert asset async author auto back backend banner base basic batch beta between binary block body book boolean border bottom branch browser buffer build bundle button bytes cache call cancel card center change channel char check child class clean clear click client clone cloud code collection color column command comment commit common compile component config connect console const container content context control cookie copy core count create current cursor custom data database date debug default define delete demo deploy desc design detail device dialog digest dir direct disable display document domain down draft driver edit editor element email empty enable encode engine entry enum env error event example except exec export extend external factory false feature fetch field file filter final find first flag flex float folder font footer form format frame from function future gallery general generate get global graph grid group guide handle hash head header height hello help hidden history home host html http icon image import index info init inline inner input insert install int integer interface internal invalid item java join json keep kernel label lang language last layer layout left length level library license limit line link list load local lock logger login logo long loop main manager map margin mark master match matrix max media member memory menu merge message meta method middle mobile mock mode model module month mount move multi name native nav next node none normal note null number object offset open option order origin other output overlay owner package padding page panel parent parse part patch path pattern payload phone pixel placeholder plain play plugin point policy popup port position post prefix press preview print private process product profile project promise property protocol proxy public query queue random range read record redirect refresh region register release remote remove render replace report request require reset resource response rest result return right role root route rule runtime safe sample save scale schema scope screen script scroll search second section select send sequence server service session set setting setup shadow share shell show side sign simple single size slide snapshot socket solid sort source space span spec split stack standard start state static status step storage store stream string strong style submit success summary support switch symbol sync system table target task team template term test text theme thread thumb time title today toggle tool top total track trace transform tree true type under unique unit update upload upper url user utils valid value variable vector version vertical video view virtual visible wait warning watch web week white widget width window word work world write year your zone changeme dummy foobar replace insert redacted xxxx lorem ipsum""".split())
NEAR_SECRET = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "auth", "bearer", "credential", "private", "client_secret", "key")
NEAR_HASH = ("sha", "md5", "commit", "checksum", "digest", "hash", "etag", "uuid", "guid", "integrity", "revision", "rev", "blob", "tree", "build", "id", "fingerprint", "serial", "isbn", "phone", "card", "number", "order")
NEAR_FAKE = ("example", "dummy", "test", "sample", "placeholder", "your", "fake", "changeme", "mock", "demo", "redacted", "todo")
PATH_FAKE = ("test", "example", "sample", "fixture", "mock", "doc", "readme", "lock", ".min.", "spec", "vendor", "node_modules")
PATH_TRUE = (".env", "config", "settings", ".yml", ".yaml", ".properties", ".tf", "deploy", "credential", ".ini", "secret")
FEATURES = ("length", "entropy", "transitions", "class_changes", "digits", "upper", "hex_only", "longest_letters", "dictionary", "distinct", "near_secret", "near_hash", "near_fake", "own_fake", "path_fake", "path_true", "assigned", "quoted", "in_url", "dashes")


@dataclass(frozen=True)
class Finding:
    """A candidate as found, and whether it is a secret."""

    text: str
    begin: int
    end: int
    path: str = ""
    label: int | None = None


def mixed(v: str) -> bool:
    """Whether the case of letters changes at a fourth of the places or more."""
    return not (v.islower() or v.isupper()) and 4 * sum(a.islower() != b.islower() for a, b in zip(v, v[1:])) >= len(v)


def candidates(text: str) -> list[tuple[int, int]]:
    """Ranges of candidates in a text, apart from each other, in order."""
    found = [m.span() for m in LONG.finditer(text) if any(map(str.isdigit, m[0])) or mixed(m[0])]
    low = text.lower()
    if "://" in text:
        found += [m.span(1) for m in LOGIN.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [m.span() for m in BLOCK.finditer(text)]
    if any(h in low for h in HINTS):
        found += [m.span(1) for m in GIVEN.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.cache
def _transitions() -> dict[str, float]:
    """Log probabilities of letter pairs in the vocabulary."""
    pairs, firsts = Counter(), Counter()
    for w in WORDS:
        for a, b in zip(w, w[1:]):
            pairs[a + b] += 1
            firsts[a] += 1
    return {a + b: math.log((pairs[a + b] + 0.3) / (firsts[a] + 0.3 * 27)) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def covered(value: str) -> float:
    """The share of characters inside vocabulary words of four letters or more, longest first."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 3, -1):
            if low[at : at + n] in WORDS:
                hit += n
                at += n
                break
        else:
            at += 1
    return hit / len(low)


def features(f: Finding) -> list[float]:
    v = f.text[f.begin : f.end]
    n, counts, low = len(v), Counter(v), v.lower()
    log = _transitions()
    pairs = [log.get(low[i : i + 2], -5.0) for i in range(n - 1)]
    before = f.text[max(0, f.begin - 60) : f.begin].lower()
    after = f.text[f.end : f.end + 30].lower()
    line = before.rsplit("\n", 1)[-1]
    words = re.findall(r"[a-z][a-z_\-]*\d*", line)[-4:]
    around = f"{before} {after}"
    path = f.path.lower()
    near = lambda names: float(any(any(x in w for x in names) for w in words))
    letters = max(map(len, re.findall(r"[A-Za-z]+", v)), default=0)
    return [
        float(min(n, 400)), -sum(c / n * math.log2(c / n) for c in counts.values()), sum(pairs) / max(1, len(pairs)), sum(_kind(a) != _kind(b) for a, b in zip(v, v[1:])) / n,
        sum(map(str.isdigit, v)) / n, sum(map(str.isupper, v)) / n, float(re.fullmatch(r"[0-9a-fA-F]+", v) is not None), letters / n, covered(v), len(counts) / min(n, 64),
        near(NEAR_SECRET), float(any(w in NEAR_HASH or w.rstrip("0123456789") in NEAR_HASH for w in words)), float(any(x in around for x in NEAR_FAKE)), float(any(x in low for x in NEAR_FAKE) or max(counts.values()) > n / 2),
        float(any(x in path for x in PATH_FAKE)), float(any(x in path for x in PATH_TRUE)), float(re.search(r"(?:[:=]|=>)\s*[\"'`]?$", before) is not None), float(before[-1:] in "\"'`" and before != ""), float("://" in before.rsplit(" ", 1)[-1] or "/" in v and "." in before[-20:].rsplit(" ", 1)[-1]), v.count("-") / n,
    ]


def labelled_findings(n: int = 4000, seed: int = 1) -> list[Finding]:
    """A seeded set of labelled findings after public formats: half secrets, half what is mistaken for them."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k, of=alnum: "".join(r.choice(of) for _ in range(k))
    hexa = lambda k: some(k, "0123456789abcdef")
    word = lambda: r.choice(sorted(WORDS))
    invented = lambda: "".join(r.choice(["the", "on", "er", "an", "re", "ing", "ti", "st", "de", "la", "ch", "en", "que", "ou", "un"]) for _ in range(r.randrange(1, 5)))
    prose = lambda: " ".join(r.choice([word, invented])() for _ in range(r.randrange(0, 12)))
    paths = ["", "src0", "src7", "app/config.yml", ".env", "deploy/settings.py", "src/main.c", "lib/net.js", "infra/main.tf", "notes.txt"]
    fakes = ["tests/test_auth.py", "docs/readme.md", "package-lock.json", "examples/demo.py", "vendor/x.min.js", "", "src3", "src12", "src/main.c"]
    letters = alnum[:52]
    out = []
    while len(out) < n:
        label = len(out) % 2
        after = None
        if label:
            value = r.choice([lambda: hexa(40), lambda: hexa(32), lambda: hexa(64), lambda: some(40), lambda: some(r.randrange(20, 64)), lambda: "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), lambda: "ghp_" + some(36), lambda: "sk_live_" + some(24), lambda: "xoxb-" + some(11, "0123456789") + "-" + some(24), lambda: base64.b64encode(r.randbytes(r.randrange(18, 40))).decode(), lambda: some(r.randrange(10, 20), alnum + "!#%&*"), lambda: some(r.randrange(20, 48), letters)])()
            name = r.choice(["token", "secret", "password", "api_key", "apiKey", "API_KEY", "auth_token", "client_secret", "access_key", "SECRET_KEY", "passwd", "private_key"])
            head = r.choice([f'{name} = "', f"{name}: ", f"{name}={''}", f'"{name}": "', f"export {name.upper()}=", "Authorization: Bearer ", f"{name} := '"])
            odd = r.random()
            if odd < 0.06:
                value, head, after = some(r.randrange(8, 24), r.choice([letters, alnum, alnum + "!#%&*"])), f"{word()}://{word()}:", f"@{word()}.{word()}/{word()}"
            elif odd < 0.12:
                kind = r.choice(["", "RSA ", "EC ", "OPENSSH "])
                body = base64.b64encode(r.randbytes(r.randrange(60, 900))).decode()
                value = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + f"\n-----END {kind}PRIVATE KEY-----"
                head = r.choice(["", "", f"{name}: ", f'{name} = "'])
        else:
            value = r.choice([lambda: hexa(40), lambda: hexa(64), lambda: hexa(32), lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: some(16, "0123456789"), lambda: some(r.randrange(16, 24), "0123456789"), lambda: "_".join(word() for _ in range(4)) + str(r.randrange(99)), lambda: "-".join(word() for _ in range(4)) + str(r.randrange(2024)), lambda: "".join(word().title() for _ in range(4)) + str(r.randrange(9)), lambda: "your-" + word() + "-token-123", lambda: "x" * 20 + "1", lambda: "/".join(word() for _ in range(4)) + "/v2", lambda: "changeme123", lambda: "".join(word().title() for _ in range(r.randrange(4, 8))), lambda: "".join(x.title() for x in invented().split("e")) + invented().title() + invented().title() + "X", lambda: "sha512-" + base64.b64encode(r.randbytes(64)).decode(), lambda: invented() + invented() + invented() + str(r.randrange(99)), lambda: "=" * 20 + "1" + "-" * 20])()
            head = r.choice(["commit ", "sha256: ", "md5sum ", "revision ", "id ", "see https://host.example/", "#", "checksum = ", "etag: ", "uuid=", "order number ", "card ", "phone ", "digest: ", "", "", 'password = "example', "token = your", "class ", "def ", "import ", "  <h1>"])
            if r.random() < 0.05:
                value, head, after = r.choice(["password", "your-password", "changeme", "<password>", "example", "placeholder", "${PASSWORD}"]), f"{word()}://{word()}:", f"@{word()}.{word()}/{word()}"
        before = prose() + r.choice([" ", "\n", "### ", ". "]) + head
        path = r.choice(fakes if not label and r.random() < 0.6 else paths)
        out.append(Finding(before + value + (after if after is not None else r.choice(['"', "", " ", "'", "\n", '"### ', " la "])) + prose(), len(before), len(before) + len(value), path, label))
    return out


def findings_of(table: DataFrame, most: int = 4000, seed: int = 1) -> list[Finding]:
    """A project's own labelled findings, rows (text, begin, end, path, label): a seeded sample of at most `most` (the bound on what the forest is fitted on), by the order of a hash of the whole row."""
    own = table.select("text", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("label").cast("int").alias("label")).where("text IS NOT NULL AND label IS NOT NULL AND begin >= 0 AND begin < end")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*own.columns))).cast("binary"))
    return [Finding(r.text, r.begin, r.end, r.path, r.label) for r in own.orderBy(order).limit(most).collect()]


def fit(findings: list[Finding], seed: int = 0) -> forest.Forest:
    return forest.train(np.array([features(f) for f in findings]), np.array([f.label for f in findings], float), seed=seed)


def scan_text(text: str | None, path: str | None, model: forest.Forest, at: float) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all candidates of a text; secrets are those of a score of `at` or more."""
    found = candidates(text) if text else []
    if not found:
        return []
    scores = model.predict(np.array([features(Finding(text, a, b, path or "")) for a, b in found]))
    return [(a, b, float(s)) for (a, b), s in zip(found, scores)]


def redact(text: str, found: list[tuple[int, int, float]], at: float) -> str:
    out, last = [], 0
    for a, b, s in found:
        if s >= at:
            out += [text[last:a], MARK]
            last = b
    return "".join([*out, text[last:]])


def scanned(docs: DataFrame, model: forest.Forest, text: str = "text", path: str = "source", at: float = 0.5, carry: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """docs (the columns of carry; all) with n_candidates, n_secrets, max_score and findings (begin, end, score of each secret); redacted: the text column has secrets replaced by MARK."""
    names = ["n_candidates", "n_secrets", "max_score", "findings"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in names]
    read = numbered_columns(docs, own, text=F.col(f"`{text}`"), path=F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit(""))
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 40 trees of at most 8,000 nodes
    item = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType(own_fields(docs, own) + [T.StructField("n_candidates", T.LongType()), T.StructField("n_secrets", T.LongType()), T.StructField("max_score", T.DoubleType()), T.StructField("findings", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(held.value)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in slices(batches, "text"):
            texts = ids_of(b, "text").to_pylist()
            every = [scan_text(t, p, trees, at) for t, p in zip(texts, ids_of(b, "path").to_pylist())]
            kept = [[x for x in f if x[2] >= at] for f in every]
            cols = dict(zip(own, own_arrays(b, len(own))))
            if redacted and text in cols:
                cols[text] = pa.array([redact(t, k, at) if k else t for t, k in zip(texts, kept)], pa.string())
            more = [pa.array([len(f) for f in every], pa.int64()), pa.array([len(k) for k in kept], pa.int64()), pa.array([max((x[2] for x in f), default=None) for f in every], pa.float64()), pa.array([[{"begin": x, "end": y, "score": s} for x, y, s in k] for k in kept], kind)]
            yield pa.RecordBatch.from_arrays([*cols.values(), *more], [*own, *names])

    return read.mapInArrow(run, schema)


@functools.cache
def default_model(n: int = 4000) -> forest.Forest:
    return fit(labelled_findings(n))


def redacted_documents(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """docs with secrets replaced, and the columns they came with."""
    names = ["n_candidates", "n_secrets", "max_score", "findings"]
    clash = {n: f"__own_{n}" for n in names if n in docs.columns}
    safe = docs.withColumnsRenamed(clash)
    out = scanned(safe, default_model(), text, path, redacted=True).select(*[F.col(f"`{c}`") for c in safe.columns])
    return out.withColumnsRenamed({v: k for k, v in clash.items()})


