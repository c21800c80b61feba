import re

from driftline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


CASES = [None, "", "  \n\t", "a b c a b c", "x y\nx y\n \nx y", "один два три один два три четыре", "a b c\x1fd # $ <p>", "a a a a a", "w " * 60]


def test_base_columns_match_brute_force(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect():
        if len(r.text) < 8000:
            assert quality.base(r.text)[:5] == brute(r.text)


def test_lines():
    rules = quality.LineRules()
    assert quality.line_passes("A line of running text.", rules)
    assert quality.line_passes('He said: "so it is."', rules)
    for bad in ("Home | About | Contact us | Login", "de%%% la&&& que### un***.", "BUY NOW!! CHEAP!! OFFER!! TODAY!!", "no end of sentence here", "This site needs a cookie policy."):
        assert not quality.line_passes(bad, rules), bad
    assert quality.clean("Good line here.\nHome | About | Us\n\nAnother good line.") == "Good line here.\n\nAnother good line."


def test_labels(spark, sf):
    """Documents labelled good are kept if the base rules allow it; most of those labelled bad are rejected."""
    sf = sf.replace("sf0.001", "sf0.01")
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), keep_columns=["doc_id"]).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.35 * len(bad)


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([("x", "A good line of text here. " * 20, 1), ("y", None, 2)], "kept string, text string, n_words int")
    out = quality.kept_documents(docs)
    assert out.columns == docs.columns
    assert quality.judged(docs.where("false")).count() == 0


def brute_kept(text):
    """The verdict from the rules in words: line by line, at most two equal ones count."""
    lines, left, seen = (text or "").split("\n"), 0, {}
    for x in lines:
        if not x.strip():
            continue
        seen[x] = seen.get(x, 0) + 1
        closed = x.rstrip()
        while closed and closed[-1] in "\"')]”’»›":
            closed = closed[:-1]
        upper = sum(c.isupper() for c in x)
        fine = closed[-1:] and closed[-1] in ".!?:;…。！？؟।" and sum(x.count(c) for c in "#*$%&|<>") <= 0.3 * len(x.split())
        fine = fine and not (upper >= 8 and upper > 0.7 * sum(c.isalpha() for c in x)) and seen[x] <= 2
        if fine and not quality.NAVIGATION.search(x) and not quality.BOILERPLATE.search(x):
            left += sum(not c.isspace() for c in x)
    n, chars, _, _, repeated, _ = quality.base(text)
    return n >= 50 and 100 * repeated <= 50 * n and 2 * left >= chars


def test_verdicts_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute_kept(r.text) for r in docs.collect()}
    assert {r.doc_id: r.kept for r in quality.judged(docs).collect()} == want and set(want.values()) == {True, False}


def test_a_very_long_text(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "repeat('A line of some running text. ', 200000) AS text", "1 AS `a.b`", "2 AS c0")
    r = quality.judged(docs).first()
    assert r.n_words == 1_200_000 and r.base_failed and (r["a.b"], r.c0) == (1, 2)
