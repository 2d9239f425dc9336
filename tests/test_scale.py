"""Jobs that must stay whole and flat in memory on larger inputs (round 3)."""

import json

from pyspark.sql import functions as F

from tuneval import schemas as S
from tuneval.sources import files


def test_array_files_are_whole_whatever_the_sides_sizes(spark, tmp_path):
    """The brackets meet their lines also where the engine coalesces small partitions; rows of one position are kept."""
    from tuneval.plans.q_files import write_array_files
    n = 40000
    rows = spark.range(n).select(
        F.concat(F.lit("b"), (F.col("id") % 40).cast("string")).alias("bucket"), F.lit(None).cast("string").alias("name"),
        F.floor(F.col("id") / 80).alias("pos"),
        F.format_string('{"instruction":"%d","input":"%s","output":""}', "id", F.sha2(F.col("id").cast("string"), 512))
        .alias("value"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        path = write_array_files(rows, [None], str(tmp_path / "arrays"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    per = {}
    for f in (tmp_path / "arrays").glob("bucket=*/*.txt"):
        per.setdefault(f.parent.name, []).append([int(x["instruction"]) for x in json.loads(f.read_text())])
    assert len(per) == 40 and all(len(x) == 1 for x in per.values())
    assert sorted(i for x in per.values() for i in x[0]) == list(range(n))
    assert all([i // 80 for i in x[0]] == sorted(i // 80 for i in x[0]) for x in per.values())
    d = files.read_instruction_array(spark, path, S.INSTRUCTION)
    assert d.count() == n


def test_rouge_n_keeps_ngrams_in_their_row(spark):
    """No row per n-gram, whose hash table would grow with a task's texts; rows of one key count as one."""
    from collections import Counter
    from tuneval.operators import textsim
    long = [" ".join(f"w{(i * k) % 61}" for i in range(700)) for k in (7, 11)]
    rows = [(1, "a b a b c", "b a b a a"), (2, *long), (3, "", ""), (4, "x", "x"), (None, "a b", "b a"),
            (5, "a a b", "a b"), (5, "b b", "a b b")]
    d = textsim.rouge_n(spark.createDataFrame(rows, "id int, response string, reference string"), ["id"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    got = {r.id: (r.rouge1, r.rouge2) for r in d.collect()}
    want = {}
    for n in (1, 2):
        sides = {}
        for i, *texts in rows:
            for side, t in enumerate(texts):
                w = t.split()
                sides.setdefault(i, (Counter(), Counter()))[side].update(
                    tuple(w[k:k + n]) for k in range(len(w) - n + 1))
        for i, (p, r) in sides.items():
            common = sum((p & r).values())
            want.setdefault(i, []).append(2.0 * common / (p.total() + r.total()) if common else 0.0)
    assert got == {i: tuple(x) for i, x in want.items()}


def test_json_items_of_one_row_group_are_many_tasks(spark, tmp_path):
    """Events take few bytes: a file that is one scan task must not be parsed by one task."""
    from tuneval.sources import fixtures as fx
    e = spark.range(300000).select(
        F.col("id").alias("event_id"), F.lit("click").alias("event_type"), (F.col("id") * 7919 % 100003).alias("user_id"),
        F.concat(F.lit('{"k": '), (F.col("id") * 31 % 1009).cast("string"), F.lit("}")).alias("props"))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = fx.json_items(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 1 and sum(r["count"] for r in rows) == 900000


def test_stream_state_is_shared_by_many_keys(spark, tmp_path):
    """Calls per key cost more than the key's work: keys share states, copies still count once, null keys too."""
    from tuneval.streaming import streams
    n, raw = 6000, '{"response_a_scores": {}, "response_b_scores": {}, "winner": "A"}'
    v = spark.range(n).select(
        F.lit("cp1_vs_cp0").alias("comparison"), F.when(F.col("id") > 0, F.col("id") + F.lit(1 << 60)).alias("prompt_id"),
        F.lit(0).alias("swap"), F.lit(raw).alias("raw"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("arrived_at"))
    for part in "ab":
        v.coalesce(1).write.json(str(tmp_path / part))
    q, out = streams.verdict_win_rates(spark, str(tmp_path / "*"), state_path=str(tmp_path / "s"), out_path=str(tmp_path / "r"))
    q.awaitTermination()
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= streams.GROUPS
    r = streams.changed_results(spark, out, ["comparison"]).collect()
    assert [(x.total_pairs, x.challenger_wins, x.max_arrived.timestamp()) for x in r] == [(n, n, 1704067200.0 + n - 1)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_taxonomy_parses_a_text_once(spark):
    """A filter on validity would be pushed into what makes the text and parse it several times a row."""
    from tuneval.operators import jsonq
    texts = ["", "x", '{"a": 1}', "{'a': 1}", '{"a": 1', '{"a" 1}', '{"a": 1} x', "```json\n{}\n```", "[1, 2", '"ab', None, " 7\n"]
    d = jsonq.error_taxonomy(spark.createDataFrame([("cp0", t) for t in texts], "checkpoint string, response string"))
    assert _plan(d).count("parseJson") == 1
    got = {r.error_class: r.n for r in d.collect()}
    assert got == {"invalid_value": 4, "missing_colon_or_key": 2, "missing_comma": 2, "extra_data": 1, "unterminated_string": 1}


def test_texts_without_the_outline_of_a_value_are_not_parsed(spark):
    """The parser throws for each of them; what has the outline is judged by the parser."""
    from tuneval.functions import jsonfn as J
    valid = ["{}", "{ }", "[]", '""', '"a\nb"'.replace("\n", "\\n"), "5", "-1.5e3", " true ", "null", "\n{\t\"a\":\n1}\r\n", "[[1], {}]", "0"]
    invalid = ["", " ", "{'a':1}", '{"a":1', "```json\n{}\n```", "Sure: {} Done.", '"', "{", "1 2", '{"a":1}}', "nullx", "NaN", "-", "+1",
               "﻿1", " 1", "[1],[2]", "[1,]", '{"a":1} ', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(valid + invalid)], "i int, t string")
    got = {r.i: (r.a, r.ok, r.v) for r in J.with_parsed(df, "t", "ok", "v").select(
        "i", J.strict_valid("t").alias("a"), "ok", F.col("v").isNotNull().alias("v")).collect()}
    assert got == {i: (i < len(valid),) * 3 for i in range(len(valid) + len(invalid))}
    assert "RLIKE" in _plan(df.select(J.strict_valid("t")))


def test_equal_texts_are_parsed_once(spark):
    """The expected text is parsed only if the response is valid and another text."""
    from tuneval.operators import jsonq
    rows = [('{"a": 1}', '{"a": 1}', 1, 1, 1), ('{"a":1.0}', '{"a": 1}', 1, 1, 1), ("x", "x", 0, 0, 0), ('{"a": 1}', "x", 1, 0, 0),
            ('{"a": 2, "b": 1}', '{"a": 1}', 1, 1, 0), (None, None, 0, 0, 0), ("1", None, 1, 0, 0), (None, "1", 0, 0, 0), ("1", "1", 1, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, response string, expected string, a int, b int, c int")
    d = jsonq.judge_json_flags(df)
    assert "<=>" in _plan(d)
    assert all((r.valid, r.schema, r.exact) == (r.a, r.b, r.c) for r in d.collect())


def _conversations(spark, folder, n=3000):
    turn = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") % 2 + 1).cast("int"))
    c = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("conv_id"), (F.col("id") % 2).alias("turn"), turn.alias("role"),
                                  F.concat(F.lit("Some words "), F.col("id").cast("string"), F.lit(". And more.")).alias("text"))
    c.coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    e = spark.range(50).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % k + 1).cast("float") for k in (2, 3, 5)]).alias("embedding"))
    e.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return n


def test_verdicts_of_few_bytes_are_many_tasks(spark, tmp_path):
    """Prompt ids take few bytes: what is made and parsed of them must not be one task's work."""
    from tuneval.sources import fixtures as fx
    n = _conversations(spark, tmp_path)
    rows = fx.verdicts(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == 3 * n


def test_prompts_and_responses_are_made_once(spark, tmp_path):
    """Texts and vectors share them: neither is made again from the conversations."""
    from tuneval.plans import q_text
    n = _conversations(spark, tmp_path, 300)
    d = q_text.open_rows(spark, str(tmp_path))
    assert "lead(" not in _plan(d) and "kept" not in _plan(d)
    assert 0 < d.count() <= 3 * n


def test_text_scores_of_odd_rows(spark):
    """Rows without tokens or vectors, and of more than one batch."""
    from tuneval.operators import textsim
    v = [[1.0, 0.0], [0.0, 2.0]]
    rows = [(1, v, v), (2, [], v), (3, v, None), (4, None, None), (5, [[0.0, 0.0]], v), (6, [[0.0, 3.0]], v), (7, [], [None])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        b = textsim.bertscore(spark.createDataFrame(rows, "id int, pred array<array<double>>, ref array<array<double>>").coalesce(1))
        got = {r.id: (r.bert_precision, r.bert_recall, round(r.bert_f1, 6)) for r in b.collect()}
        t = spark.createDataFrame([(i, *x) for i, x in enumerate([("a b c", "a c"), (None, "a"), ("", ""), ("x", "y"), ("b a", "a b")])],
                                  "id int, response string, reference string").coalesce(1)
        r = textsim.rouge_n(textsim.rouge_l(t, keep_tokens=True), ["id"], carry=("rougeL",))
        scores = {x.id: (x.rougeL, x.rouge1, x.rouge2) for x in r.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    zero = (0.0, 0.0, 0.0)
    assert got == {1: (1.0, 1.0, 1.0), 2: zero, 3: zero, 4: zero, 5: zero, 6: (1.0, 0.5, round(2 / 3, 6)), 7: zero}
    assert scores == {0: (0.8, 0.8, 0.0), 1: zero, 2: zero, 3: zero, 4: (0.5, 1.0, 0.0)}
