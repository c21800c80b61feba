import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import series
from driftline.plans import signals
from driftline.session import shared_dir
from driftline.sources import sinks
from driftline.streaming import changes


def replay(rows, rules):
    """The alerts by the rules in words, with nothing of the engine's state: after each observation a word's usable half-years are laid out anew and analysed."""
    seen, flags, out = {}, {}, []
    cfg = rules.analysis
    for r in sorted(rows, key=lambda r: (r.arrived, r.half_year)):
        own = seen.setdefault(r.word, {})
        usable = lambda: {h: c for h, (c, n) in own.items() if n >= rules.min_occurrences and c is not None}
        old = usable()
        own[r.half_year] = (r.cosine, r.n_occurrences)
        now = usable()
        if now == old:
            continue
        found = series.analysed(r.word, sorted(now), np.array([now[h] for h in sorted(now)]), cfg, cfg.floor) if len(now) >= rules.min_valid_periods else None
        flag = (found["changepoints"], round(found["shift"], 6)) if found and found["p_value"] < cfg.alpha and found["shift"] > 0 else None
        had = flags.get(r.word)
        flags[r.word] = flag
        event = {(False, True): "emerged", (True, False): "cleared"}.get((had is not None, flag is not None), "revised" if flag != had else None)
        if event:
            out.append({"word": r.word, "half_year": r.half_year, "event": event, "changepoints": found["changepoints"] if found else "", "p_value": found["p_value"] if found else None})
    return out


def test_stream_gives_the_alerts_of_a_replay(spark, sf):
    rows = signals.arriving(spark, sf).collect()
    want = replay(rows, signals.RULES)
    got = signals.stream_alerts(spark, sf).collect()
    key = lambda a: (a["word"], a["half_year"], a["event"], a["changepoints"], round(a["p_value"], 9))
    assert sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, want)) and want
    path = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    sinks.alert_lines(spark.createDataFrame(got), path)
    assert sorted(json.loads(r.value)["word"] for r in spark.read.text(path).collect()) == sorted(r.word for r in got)


def test_state_and_snapshot(spark):
    lab = [f"{2000 + i // 2}H{i % 2 + 1}" for i in range(12)]
    rows = [("w", h, 0.1 + (i > 5), 50, i) for i, h in enumerate(lab)] + [("few", h, 0.5, 3, i) for i, h in enumerate(lab)] + [("w", lab[2], 0.12, 60, 99), ("w", lab[3], None, 60, 99)]
    df = spark.createDataFrame(rows, "word string, half_year string, cosine double, n_occurrences long, arrived long")
    base = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(f"{base}/in")
    stream = changes.alerts(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    order = ["word", "half_year"]
    state = changes.state_points(spark, f"{base}/state").orderBy(*order).collect()
    latest = changes.latest(df).orderBy(*order).collect()
    assert [tuple(r) for r in state] == [tuple(r) for r in latest]
    snap = changes.snapshot(changes.state_points(spark, f"{base}/state")).collect()
    assert [r.word for r in snap] == ["w"] and snap[0].live_alert and snap[0].onset_half_year == lab[6] and snap[0].total_occurrences == 620
    assert spark.read.parquet(f"{base}/out").where("word = 'w' AND event = 'emerged'").count() == 1


def test_lines_and_rules(spark):
    lines = spark.createDataFrame([('{"word": "a", "half_year": "2000H1", "cosine": 0.5, "n_occurrences": 7}',), (" ",), ('{"half_year": "2000H2", "observations": [{"word": "a", "cosine": null, "n_occurrences": 1}, {"word": "b", "cosine": 1, "n_occurrences": 2}]}',)], "value string")
    got = sorted(map(tuple, changes.observations(lines).collect()), key=str)
    assert got == [("a", "2000H1", 0.5, 7), ("a", "2000H2", None, 1), ("b", "2000H2", 1.0, 2)]
    with pytest.raises(ValueError):
        changes.Word("a", {}, None, False).take("2000-H1", 1.0, 1, changes.Rules())
    with pytest.raises(ValueError):
        changes.Rules(min_valid_periods=5)
    with pytest.raises(Exception, match="malformed line 7"):
        changes.observations(spark.createDataFrame([("{broken", 7)], "value string, line_no long")).collect()
    with pytest.raises(Exception, match="malformed line"):
        changes.observations(spark.createDataFrame([("{}",)], "value string")).collect()
