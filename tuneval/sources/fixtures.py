"""Stand-in inputs built from the driver's tables (FIXTURES.md §3).

These only produce rows in the schemas the operators expect: instruction
records, checkpoint responses, JSON-task responses, raw judge replies and
token vectors. They do none of the evaluation work; the operators never
look at how a row was made (the ``variant`` codes stay here).

The same definitions are written in DuckDB SQL in
``tuneval.plans.oracle_fixtures`` for the driver's oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import hash_of
from ..schemas import COMPARISONS, DIMENSIONS
from ..session import scratch_table
from .tables import table

# Checkpoint names and response-length percentages of F-2.
CHECKPOINT_PCT = (("cp0", 30), ("cp1", 80), ("cp2", 75))
# Checkpoint names and share of perfect answers of F-3.
CHECKPOINT_BIAS = (("cp0", 0), ("cp1", 20), ("cp2", 60))
# Winner labels emitted by the stand-in judge (last one unknown).
WINNER_LABELS = ("A", "B", "TIE", "tie")
# Odd scores the stand-in judge writes now and then (as JSON).
ODD_SCORES = ('"abc"', "null", '"4"', "4.7", "true", "[2]")
# Turns that a conversation may have: a prompt is numbered conv_id * TURNS + turn.
TURNS = 1_000_000
OPEN_SUITE = "open"
JSON_SUITE = "json"


def _h(*parts) -> F.Column:
    return hash_of(F.concat(*parts))


def instruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-1: user turns directly followed by an assistant turn.

    The next turn comes from an exact lead without a per-conversation
    window (``ranking.lead_within``); the system turn of the conversation,
    if any, is the input (a partial aggregate joined back by id).
    """
    from ..operators.ranking import lead_within

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = lead_within(c, ["conv_id"], "turn", ["role", "text"])
    sys_ = (c.where(F.col("role") == "system").groupBy("conv_id")
             .agg(F.max("text").alias("sys")))
    q = (nxt.where((F.col("role") == "user") & (F.col("role_next") == "assistant"))
            .join(sys_, "conv_id", "left"))
    return q.select("conv_id", "turn",
                    (F.col("conv_id") * TURNS + F.col("turn")).alias("prompt_id"),
                    F.col("text").alias("instruction"),
                    F.coalesce(F.col("sys"), F.lit("")).alias("input"),
                    F.col("text_next").alias("output"))


def dealt(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt out to all shuffle partitions. They take few bytes for the work
    that follows; partitions of a given number are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written_instruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-1 written once, for queries that use the prompts several times."""
    return scratch_table(dealt(instruct(spark, sf_dir), "prompt_id"), "instruct")


def written_responses(spark: SparkSession, sf_dir: str, inst: DataFrame) -> DataFrame:
    """F-2 written once: every word of it costs a hash."""
    return scratch_table(responses(spark, sf_dir, inst), "responses")


def _checkpoints(pairs, second: str) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("checkpoint"), F.lit(b).alias(second))
                               for a, b in pairs]))


def responses(spark: SparkSession, sf_dir: str, inst: DataFrame | None = None) -> DataFrame:
    """F-2: long ``(suite, prompt_id, checkpoint, response)`` table.

    A response is made of the whole expected output: words are kept or not
    by a hash and the checkpoint's percentage, and come in order, in reverse,
    with others in the place of those not kept, or second half first. Some
    are sentinels, some empty, some rows absent.
    """
    inst = inst if inst is not None else instruct(spark, sf_dir)
    x = inst.select("prompt_id", "output", _checkpoints(CHECKPOINT_PCT, "pct").alias("c")) \
            .select("prompt_id", "output", "c.checkpoint", "c.pct")
    h = "cast(conv(substr(md5(concat(prompt_id, '|', checkpoint{})), 1, 8), 16, 10) as bigint)"
    keep = f"pmod({h.format(", '|', i + 1")}, 100) < pct"
    x = x.selectExpr("prompt_id", "checkpoint", f"pmod({h.format('')}, 20) as b", "split(output, ' ') as ws",
                     f"transform(split(output, ' '), (w, i) -> {keep}) as ks")
    x = x.selectExpr("prompt_id", "checkpoint", "b", "ws", "ks", "filter(ws, (w, i) -> get(ks, i)) as kept")
    resp = """case when b = 0 then '[no output]' when b = 1 then '[error: x]' when b = 3 then ''
              else array_join(case b % 4 when 0 then kept when 1 then reverse(kept)
                   when 2 then transform(ws, (w, i) -> case when get(ks, i) then w else 'so' end)
                   else concat(slice(kept, size(kept) div 2 + 1, size(kept)), slice(kept, 1, size(kept) div 2)) end,
                   ' ') end"""
    return x.where("b <> 2").selectExpr(f"'{OPEN_SUITE}' as suite", "prompt_id", "checkpoint", f"{resp} as response")


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-3: ``(prompt_id, checkpoint, task_type, expected, response)``.

    The expected value is an object built from an event; the response is one
    of ten shapes a model might produce (see FIXTURES.md). Written as SQL
    expressions; the shape code is referenced once (``element_at``).

    The events are dealt out before they become texts: they take few bytes, so
    a scan gives them to few tasks, and what follows parses each one.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k")).repartition("event_id", "user_id", "k")
    e = e.select("*", _checkpoints(CHECKPOINT_BIAS, "bias").alias("c")) \
         .select("event_id", "event_type", "user_id", "k", "c.checkpoint", "c.bias")
    t, u, k = "event_type", "cast(user_id as string)", "k"
    ex = f"""concat('{{"event_type": "', {t}, '", "k": ', {k}, ', "user_id": ', {u}, '}}')"""
    hh = ("pmod(cast(conv(substr(md5(concat(cast(event_id as string), '|', checkpoint)), 1, 8), "
          "16, 10) as bigint), 100)")
    e = e.selectExpr("event_id", "event_type", "user_id", "k", "checkpoint", "bias", f"{ex} as expected", f"{hh} as hh") \
         .selectExpr("*", "case when hh < bias then 0 else pmod(hh, 10) end as b")
    shapes = [
        "expected",
        f"""concat('{{"user_id": ', {u}, ', "k": ', {k}, ', "event_type": "', {t}, '"}}')""",
        f"""concat('{{"event_type": "', {t}, '", "k": ', {k}, ', "user_id": ', {u}, ', "extra": true}}')""",
        f"""concat('{{"event_type": "', {t}, '", "k": ', {k}, '}}')""",
        f"""concat('{{"event_type": "', {t}, '", "k": "', {k}, '", "user_id": ', {u}, '}}')""",
        "concat('```json', char(10), expected, char(10), '```')",
        "substr(expected, 1, length(expected) - 1)",
        "replace(expected, '\"', char(39))",
        "concat('Sure: ', expected, ' Done.')",
        "''",
    ]
    resp = f"element_at(array({', '.join(shapes)}), cast(b + 1 as int))"
    return e.selectExpr("event_id as prompt_id", "checkpoint", "event_type as task_type",
                        "expected", f"{resp} as response")


def json_schema_spec() -> F.Column:
    """Response schema of F-3 items (M3): three required fields and types."""
    return F.struct(
        F.array(F.lit("event_type"), F.lit("k"), F.lit("user_id")).alias("required_fields"),
        F.create_map(F.lit("event_type"), F.lit("string"), F.lit("k"), F.lit("number"),
                     F.lit("user_id"), F.lit("number")).alias("types"))


def _sql_hash(tag: str) -> str:
    """H(prompt_id|comparison|tag) as a SQL expression."""
    return ("cast(conv(substr(md5(concat(cast(prompt_id as string), '|', comparison, "
            f"'|{tag}')), 1, 8), 16, 10) as bigint)")


def _sql_scores(side: str) -> str:
    parts, odd = [], "array(" + ", ".join(f"'{x}'" for x in ODD_SCORES) + ")"
    for i, d in enumerate(DIMENSIONS):
        parts.append("'" + ("" if i == 0 else ", ") + '"' + d + '": ' + "'")
        parts.append(f"coalesce(try_element_at({odd}, cast(pmod({_sql_hash(side + d)}, 211) + 1 as int)), "
                     f"cast(pmod({_sql_hash(side + d)}, 7) as string))")
    return "concat('{', " + ", ".join(parts) + ", '}')"


def verdicts(spark: SparkSession, sf_dir: str, inst: DataFrame | None = None) -> DataFrame:
    """F-4: raw judge replies ``(comparison, prompt_id, swap, raw)``.

    Written as SQL expressions (one call each) rather than a long chain of
    Column calls; same rows as the DuckDB spelling in ``oracle_fixtures``.
    """
    inst = inst if inst is not None else instruct(spark, sf_dir)
    x = dealt(inst.select("prompt_id"), "prompt_id").select(
        "prompt_id", F.explode(F.array(*[F.lit(c) for c, _, _ in COMPARISONS])).alias("comparison"))
    winners = "array(" + ", ".join(f"'{w}'" for w in WINNER_LABELS) + ")"
    body = ("concat('{\"response_a_scores\": ', " + _sql_scores("a") +
            ", ', \"response_b_scores\": ', " + _sql_scores("b") +
            f", ', \"winner\": \"', element_at({winners}, cast(pmod({_sql_hash('w')}, 4) + 1 as int)), "
            "'\", \"justification\": \"pair ', cast(prompt_id as string), '\"}')")
    y = x.selectExpr("comparison", "prompt_id",
                     f"cast(pmod({_sql_hash('swap')}, 2) as int) as swap",
                     f"pmod({_sql_hash('b')}, 10) as bi", f"{body} as body")
    return y.selectExpr("comparison", "prompt_id", "swap",
                        "element_at(array(body, concat('Verdict: ', body, ' End.'), 'no verdict'), "
                        "case when bi <= 6 then 1 when bi <= 8 then 2 else 3 end) as raw")


def token_vectors(spark: SparkSession, sf_dir: str, inst: DataFrame | None = None,
                  resp: DataFrame | None = None) -> DataFrame:
    """F-5: ``(prompt_id, checkpoint, pred, ref)`` token-vector arrays (double).

    The sentences of a response and of its reference stand for tokens; a
    sentence has the vector of ``embeddings`` that its hash points to, and
    one in 41 the zero vector. A text without sentences has no vectors.
    """
    inst = inst if inst is not None else instruct(spark, sf_dir)
    resp = resp if resp is not None else responses(spark, sf_dir, inst)
    pairs = resp.join(inst.select("prompt_id", "output"), "prompt_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    units = "filter(transform(split({}, '[.]'), x -> trim(x)), x -> x <> '')"
    u = pairs.selectExpr("prompt_id", "checkpoint", "explode(array(struct('p' as side, " + units.format("response")
                         + " as us), struct('r' as side, " + units.format("output") + " as us))) as x") \
             .select("prompt_id", "checkpoint", "x.side", F.posexplode("x.us").alias("pos", "unit")) \
             .withColumn("h", _h("unit"))
    u = u.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k") \
         .withColumn("vec_id", F.col("h") % F.col("n"))
    vec = F.when(F.col("h") % 41 == 0, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.col("v"))
    g = (u.join(e, "vec_id").groupBy("prompt_id", "checkpoint")
          .agg(F.sort_array(F.collect_list(F.struct("side", "pos", vec.alias("v")))).alias("t")))

    def side(s):
        return F.coalesce(F.transform(F.filter("t", lambda x: x["side"] == s), lambda x: x["v"]),
                          F.array().cast("array<array<double>>"))
    return (pairs.select("prompt_id", "checkpoint").join(g, ["prompt_id", "checkpoint"], "left")
                 .select("prompt_id", "checkpoint", side("p").alias("pred"), side("r").alias("ref")))


def categories(inst: DataFrame) -> DataFrame:
    """Category per prompt: with a context input or open question."""
    return inst.select("prompt_id", F.when(F.coalesce(F.col("input"), F.lit("")) != "",
                                           "contextual").otherwise("open_qa").alias("category"))
