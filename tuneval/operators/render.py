"""Prompt rendering and dataset-expansion operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import jsonfn as J
from ..functions import render as R
from ..functions.hashing import hash_choice, portable_hash
from .ranking import top_k

# Chat template role tags and end-of-sequence token.
ROLE_TAGS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
END_TAG = "<|end|>\n"
EOS_TOKEN = "<|endoftext|>"

# Bytes of keywords and values that are broadcast at a time.
BROADCAST_BYTES = 8 << 20


def render_prompts(df: DataFrame, instruction="instruction", input_="input",
                   output="output") -> DataFrame:
    """C1-C5 + C9 as columns next to the id columns."""
    return df.select(
        "*",
        R.training_prompt(instruction, input_, output).alias("train_text"),
        R.inference_prompt(instruction, input_).alias("infer_text"),
        R.dialogue_prompt(instruction, output).alias("dialogue_text"),
        R.plain_prompt(instruction, input_).alias("plain_text"),
        R.teacher_prompt(instruction, input_).alias("teacher_text"))


def chat_parts(turns: DataFrame, conv="conv_id", order="turn", role="role", text="text",
               add_generation_prompt: bool = False, part_turns: int = 4096) -> DataFrame:
    """C6 in parts: ``(conv, part, chat_text)``, each of ``part_turns`` turn
    numbers at most; concatenated by ``part`` they are the conversation.

    Each message is rendered in place (a projection). Messages are gathered
    per (conversation, ``turn // part_turns``), so no group grows with a
    conversation; the last part ends with the assistant tag or the EOS token.
    System messages only when non-empty; unknown roles are dropped.
    """
    r, t = F.col(role), F.col(text)
    piece = (F.when((r == "system") & (F.coalesce(t, F.lit("")) != ""),
                    F.concat(F.lit(ROLE_TAGS["system"]), t, F.lit(END_TAG)))
              .when(r == "user", F.concat(F.lit(ROLE_TAGS["user"]), F.coalesce(t, F.lit("")),
                                          F.lit(END_TAG)))
              .when(r == "assistant", F.concat(F.lit(ROLE_TAGS["assistant"]),
                                               F.coalesce(t, F.lit("")), F.lit(END_TAG))))
    tail = ROLE_TAGS["assistant"] if add_generation_prompt else EOS_TOKEN
    part = F.floor(F.col(order) / F.lit(part_turns)).cast("long")
    msgs = turns.select(conv, order, part.alias("part"), piece.alias("_p")) \
                .where(F.col("_p").isNotNull())
    agg = msgs.groupBy(conv, "part").agg(
        F.array_sort(F.collect_list(F.struct(order, "_p"))).alias("_m"))
    body = F.array_join(F.transform("_m", lambda s_: s_["_p"]), "")
    last = F.max("part").over(Window.partitionBy(conv))   # one row per part: small
    return agg.select(conv, "part", body.alias("_body"), last.alias("_last")).select(
        conv, "part", F.when(F.col("part") == F.col("_last"), F.concat("_body", F.lit(tail)))
        .otherwise(F.col("_body")).alias("chat_text"))


def chat_render(turns: DataFrame, conv="conv_id", **how) -> DataFrame:
    """``(conv, chat_text)``, one row per conversation whatever its length.

    Joins the parts of ``chat_parts`` in order. A conversation is one value
    here, as the result asks; use the parts where it would not fit.
    """
    parts = chat_parts(turns, conv=conv, **how).groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("part", "chat_text"))).alias("_m"))
    return parts.select(conv, F.array_join(F.transform("_m", lambda s_: s_["chat_text"]), "").alias("chat_text"))


def slot_fill(items: DataFrame, templates: DataFrame, key="task_type", slots=("slot",),
              variants="variants", choice_key=None, out="prompt") -> DataFrame:
    """C10 (+D6): fill ``{slot}`` placeholders of a template of the item's type.

    ``templates(task_type, variants array<string>)``: whether it is broadcast
    is left to the planner, which knows its size in bytes. One variant is
    picked per item by ``choice_key`` (hash choice), the first otherwise.
    """
    j = items.join(templates, key)
    text = (hash_choice(F.col(variants), choice_key) if choice_key is not None
            else F.element_at(F.col(variants), 1))
    for s in slots:
        text = F.replace(text, F.lit("{" + s + "}"), F.coalesce(F.col(s).cast("string"), F.lit("")))
    return j.withColumn(out, text).drop(variants)


def per_type_quota(df: DataFrame, n: int, key="task_type", id_cols=("prompt_id",),
                   seed: str = "42") -> DataFrame:
    """C11: ``n`` rows per task type in seeded hash order."""
    d = df.withColumn("_h", portable_hash(F.lit(seed), *id_cols))
    return top_k(d, [key], ["_h", *id_cols], n).drop("_h")


def expand_with_fallback(templates: DataFrame, variations: DataFrame, n: int,
                         key="task_type") -> DataFrame:
    """The first ``n`` variations of a template's type, else the base pair
    ``n`` times.

    ``templates(task_type, instruction, input)``,
    ``variations(task_type, instruction, input, position)``. A type that two
    templates name yields its variations for each of them.
    """
    v = top_k(variations, [key], ["position"], n).select(
        key, F.col("instruction").alias("_i"), F.col("input").alias("_x"))
    j = templates.select(key, "instruction", "input").join(v, key, "left")
    times = F.when(F.col("_i").isNull(), F.lit(n)).otherwise(F.lit(1))
    return (j.withColumn("_n", F.explode(F.sequence(F.lit(1), times)))
             .select(key, F.coalesce("_i", "instruction").alias("instruction"),
                     F.when(F.col("_i").isNull(), F.col("input")).otherwise(F.col("_x")).alias("input")))


def canonical_output(df: DataFrame, col="output", out="output") -> DataFrame:
    """Re-serialise parsed JSON (text stays if it does not parse)."""
    v = J.parse_strict(col)
    return df.withColumn(out, F.coalesce(J.canonical(v), F.col(col)))


def _first_keyword(keywords):
    """Place of the first of the broadcast keywords that a text contains, by an
    automaton (a trie with failure links) that a task builds once; a place is
    told only for texts that contain one."""
    def run(batches):
        import ahocorasick
        trie, everywhere = ahocorasick.Automaton(), None
        for i, k in reversed(list(enumerate(keywords.value))):
            if k:
                trie.add_word(k, i)          # of equal keywords the first stays
            else:
                everywhere = i               # the empty keyword is part of any text
        if len(trie):
            trie.make_automaton()
        for b in batches:
            rows, places = [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    found = [i for _, i in trie.iter(t)] if len(trie) else []
                    if everywhere is not None:
                        found.append(everywhere)
                    if found:
                        rows.append(n)
                        places.append(min(found))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())),
                                              pa.array(places, pa.int64())], names=[b.schema.names[0], "_i"])
    return run


def keyword_lookup(texts: DataFrame, dictionary: DataFrame, text="text", id_col="doc_id",
                   keyword="keyword", priority="priority", value="entity",
                   out="entity", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Value of the first dictionary key (by priority, then key) contained
    in the text; null without one.

    The dictionary is a stated query set: its bytes are summed first and it is
    sent out in blocks of about ``block_bytes``, dealt by a hash. A block is an
    automaton, so a text is read once per block, however many keywords it has.
    Texts are not shuffled for it, only the ids of those with a keyword. Null
    keywords match nothing.
    """
    spark = texts.sparkSession
    d = dictionary.select(F.col(keyword).alias("_kw"), F.col(priority).alias("_pr"),
                          F.col(value).alias("_val")).where("_kw is not null")
    size = F.octet_length("_kw") + F.coalesce(F.octet_length(F.col("_val").cast("string")), F.lit(0)) + 16
    total = d.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    t = texts.select(id_col, text)
    found = T.StructType([t.schema[id_col], T.StructField("_i", T.LongType())])
    hits = None
    for i in range(blocks):
        part = d if blocks == 1 else d.where(F.pmod(F.xxhash64("_kw", "_pr"), F.lit(blocks)) == i)
        rows = part.orderBy(F.asc_nulls_last("_pr"), "_kw").collect()
        run = _first_keyword(spark.sparkContext.broadcast([r["_kw"] for r in rows]))
        named = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                                      T.StructType([T.StructField("_i", T.LongType()), *d.schema.fields]))
        h = t.mapInArrow(run, found).join(F.broadcast(named), "_i").drop("_i")
        hits = h if hits is None else hits.unionByName(h)
    first = hits.groupBy(id_col).agg(F.min(F.struct(F.col("_pr").isNull().alias("_n"), "_pr", "_kw", "_val"))["_val"].alias(out))
    return texts.join(first, id_col, "left")
