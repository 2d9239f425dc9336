"""File sources/sinks and streams (A1-A10, L1, L2)."""

import json
import os
import tempfile

from tuneval.operators import tokens
from tuneval.functions import render as R
from tuneval.sources import files
from tuneval.streaming import streams


def _write(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f, indent=2)


def test_instruction_array_positions(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/train.json", [{"instruction": f"i{k}", "input": "", "output": "o"} for k in range(5)])
    df = files.read_instruction_array(spark, f"{d}/train.json")
    assert sorted((r.prompt_id, r.instruction) for r in df.collect()) == [(k, f"i{k}") for k in range(5)]


def test_suite_and_model_containers(spark):
    d = tempfile.mkdtemp()
    row = {"instruction": "q", "input": "", "expected_output": "e", "baseline_response": "b",
           "phase1_alpaca_response": "p1", "phase2_json_response": None}
    _write(f"{d}/suites.json", {"alpaca": [row, row], "json": [row]})
    s = files.read_suite_container(spark, f"{d}/suites.json")
    assert s.count() == 3
    long = files.wide_to_long(s)
    assert sorted({r.checkpoint for r in long.collect()}) == ["cp0", "cp1"]   # absent cp2 skipped
    _write(f"{d}/models.json", {"baseline": [{"prompt_idx": 0, "instruction": "q", "response": "r"}],
                                "stage2_json": [{"prompt_idx": 0, "instruction": "q", "response": "s"}]})
    m = files.read_model_container(spark, f"{d}/models.json")
    assert sorted((r.checkpoint, r.response) for r in m.collect()) == [("cp0", "r"), ("cp2", "s")]


def test_metadata_and_trainer_state(spark):
    d = tempfile.mkdtemp()
    for e, loss in [(1, 11.3785), (2, 10.6663), (3, 10.81)]:
        _write(f"{d}/ablation_epochs{e}_metadata.json",
               {"epochs": e, "learning_rate": 2e-5, "batch_size": 2, "gradient_accumulation_steps": 8,
                "training_loss": loss, "checkpoint_path": "c", "output_dir": "o"})
    m = files.read_run_metadata(spark, f"{d}/ablation_epochs*_metadata.json")
    assert sorted(r.epochs for r in m.collect()) == [1, 2, 3]
    _write(f"{d}/trainer_state.json", {"epoch": 2.0, "global_step": 8, "max_steps": 8, "num_train_epochs": 2,
                                       "log_history": [{"epoch": 1.0, "grad_norm": 1.0, "learning_rate": 1e-5,
                                                        "loss": 11.6, "step": 4}]})
    t = files.read_trainer_state(spark, f"{d}/trainer_state.json").collect()
    assert len(t) == 1 and t[0].step == 4


def test_logs_of_one_folder_stay_apart_and_grow(spark):
    d = tempfile.mkdtemp()
    with open(f"{d}/a.err", "w") as f:
        f.write("start\n{'loss': '2.5', 'epoch': '0.5'}\n{'loss': '1.5', 'epoch': '1.0'}\n{'loss': '1.75'}\n")
    with open(f"{d}/b.err", "w") as f:
        f.write("{'loss': '9.5', 'epoch': '7.0'}\n{'epoch': '6.0'}\n")

    def rows(df):
        return sorted((os.path.basename(r.log), r.loss, r.epoch, r.lines) for r in df.collect())

    def stream():
        q, out = streams.training_log_monitor(spark, d, state_path=f"{d}-state", out_path=f"{d}-out", range_bytes=40)
        q.awaitTermination()
        return rows(streams.changed_results(spark, out, ["log"]))
    want = [("a.err", 1.75, 1.0, 3), ("b.err", 9.5, 6.0, 2)]
    assert rows(streams.poll_training_logs(spark, d)) == stream() == want
    with open(f"{d}/a.err", "a") as f:      # a line, and half of one
        f.write("{'loss': '0.5', 'epoch': '2.0'}\n{'loss': '0.2")
    assert stream() == [("a.err", 0.5, 2.0, 4), want[1]]
    with open(f"{d}/c.err", "w") as f:      # a further log, and the line's other half
        f.write("{'loss': '3.0', 'epoch': '1.0'}\n")
    with open(f"{d}/a.err", "a") as f:
        f.write("5'}\n")
    last = [("a.err", 0.25, 2.0, 5), want[1], ("c.err", 3.0, 1.0, 1)]
    assert stream() == last == rows(streams.poll_training_logs(spark, d))
    assert len(os.listdir(f"{d}-out")) >= 3      # each run published what it changed


def test_log_ranges_agree(spark):
    """However a log is split, its lines keep their order."""
    d = tempfile.mkdtemp()
    with open(f"{d}/a.err", "w") as f:
        f.writelines(f"{{'loss': '{k}.5', 'epoch': '{k}'}}{'x' * (k % 50)}\n" for k in range(2000))
    for size in ("128m", "9000", "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = streams.poll_training_logs(spark, d).collect()
        assert [(r.loss, r.epoch, r.lines) for r in got] == [(1999.5, 1999.0, 2000)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _text(rng):
    return "".join(rng.choice('ab{}[],:"\\ \n\té€') for _ in range(rng.randrange(30)))


def test_json_arrays_in_byte_ranges(spark):
    """1, few and many byte ranges give the same elements in the same places."""
    import random
    from tuneval.sources import json_ranges as JR
    rng, d, e = random.Random(3), tempfile.mkdtemp(), tempfile.mkdtemp()
    recs = [{"instruction": _text(rng), "input": _text(rng), "output": json.dumps({"a": [1, {"b": _text(rng)}]})}
            for _ in range(300)]
    want = [(i, r["instruction"], r["input"], r["output"]) for i, r in enumerate(recs)]
    for name, opts in (("a", {"indent": 2}), ("b", {"ensure_ascii": False})):
        with open(f"{d}/{name}.json", "w") as f:
            json.dump(recs, f, **opts)
    with open(f"{d}/empty.json", "w") as f:
        f.write(" [ ] ")
    with open(f"{e}/box.json", "w") as f:
        json.dump({"x\"y": recs[:90], "none": [], "z": recs[90:]}, f, indent=1)
    schema, ranges = "struct<instruction:string,input:string,output:string>", []
    for size in ("128m", "15000", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        ranges.append(JR.summaries(JR.read_pieces(spark, d)).count())
        got = JR.read_array(spark, d, schema).select("source_file", "position", "r.*").collect()
        for name in "ab":
            assert sorted(tuple(r)[1:] for r in got if r.source_file.endswith(f"/{name}.json")) == want
        assert len(got) == 600
        box = JR.read_container(spark, e, schema).select("key", "position", "r.instruction").collect()
        assert sorted(map(tuple, box)) == sorted([('x"y', i, r["instruction"]) for i, r in enumerate(recs[:90])]
                                                 + [("z", i, r["instruction"]) for i, r in enumerate(recs[90:])])
    for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{c}")
    assert ranges[0] == 3 and 7 < ranges[1] < 40 and ranges[2] > 64


def test_broken_json_files_are_errors(spark):
    import pytest
    good = json.dumps([{"instruction": "i}", "input": "", "output": "o"}] * 9, indent=1)
    row = '{"instruction": "i"}'
    broken = {"truncated": good[:len(good) // 2], "empty": "", "no end": good[:-1], "two ends": good + "]",
              "object": row, "trailing comma": f"[{row},]", "no comma": f"[{row} {row}]", "wrong end": f"[{row}}}",
              "no objects": "[1, 2]", "text behind": f"[{row}] x", "open string": good[:60] + '"' + good[60:]}
    for name, text in broken.items():
        path = f"{tempfile.mkdtemp()}/t.json"
        with open(path, "w") as f:
            f.write(text)
        for read in (files.read_instruction_array, files.read_suite_container):
            with pytest.raises(Exception, match=r"t\.json: .* at byte \d+"):
                read(spark, path).count()
    with open(path, "w") as f:
        f.write(good)
    assert files.read_instruction_array(spark, path).count() == 9
    with pytest.raises(Exception, match="not one object of arrays at byte"):
        files.read_suite_container(spark, path).count()
    for read in (files.read_run_metadata, files.read_trainer_state):
        for text in ('{"epochs": 1', ""):
            with open(path, "w") as f:
                f.write(text)
            with pytest.raises(Exception, match="t.json"):
                read(spark, path).collect()


def test_tokens_left_pad_and_prefix_property(spark):
    df = spark.createDataFrame([("i", "x", "out put")], "instruction string, input string, output string")
    r = df.select(R.training_prompt("instruction", "input", "output").alias("t"),
                  R.inference_prompt("instruction", "input").alias("p")).collect()[0]
    assert r.t.startswith(r.p)                                     # C2 is a prefix of C1
    e = tokens.encode(df.withColumn("text", R.training_prompt("instruction", "input", "output")),
                      "text", max_length=40).collect()[0]
    n = e.n_tokens
    assert len(e.input_tokens) == 40 and e.input_tokens[:40 - n] == [tokens.PAD_TOKEN] * (40 - n)
    assert sum(e.attention_mask) == n and e.labels == e.input_tokens


def test_keyword_lookup_chunked_equals_single(spark):
    from tuneval.operators import render
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["alpha beta", "gamma", "beta delta", "nothing here", "delta alpha"])], "doc_id long, text string")
    d = spark.createDataFrame([(k, p, f"e_{k}") for p, k in enumerate(
        ["delta", "beta", "alpha", "zeta", "eta", "theta", "iota"])],
        "keyword string, priority int, entity string")
    one = {r.doc_id: r.entity for r in render.keyword_lookup(texts, d).collect()}
    many = {r.doc_id: r.entity for r in render.keyword_lookup(texts, d, block_bytes=60).collect()}
    assert one == many == {0: "e_beta", 1: None, 2: "e_delta", 3: None, 4: "e_delta"}


def test_keyword_lookup_against_brute_force(spark):
    import random
    from tuneval.operators import render
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    d = [(w, rng.randrange(50) if rng.random() < 0.95 else None, f"e{k}") for k, w in enumerate(words)]
    d += [(None, 0, "null"), ("é", 1, "accent")]
    texts = [(k, "".join(rng.choice("abcdxyz é") for _ in range(rng.randrange(40)))) for k in range(200)]
    texts += [(1000, None), (1001, ""), (1002, "zzzz")]

    def first(t, words):
        hits = [(p is None, p or 0, w, e) for w, p, e in words if w is not None and t is not None and w in t]
        return {e for h, *r, e in sorted(hits) if [h, *r] == list(min(hits)[:3])} or {None}
    td = spark.createDataFrame(texts, "doc_id long, text string")
    for more in ([], [("", 7, "always")]):
        dd = spark.createDataFrame(d + more, "keyword string, priority int, entity string")
        for size in (1 << 23, 2000):
            got = {r.doc_id: r.entity for r in render.keyword_lookup(td, dd, block_bytes=size).collect()}
            assert set(got) == {k for k, _ in texts}
            assert all(got[k] in first(t, d + more) for k, t in texts)


def test_chat_render_parts_concatenate(spark):
    from tuneval.operators import render
    rows = [(1, i, ["system", "user", "assistant", "tool"][i % 4] if i else "system", f"m{i}")
            for i in range(23)] + [(2, 0, "system", ""), (2, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r.chat_text for r in render.chat_render(df).collect()}
    parts = render.chat_parts(df, part_turns=5).collect()
    assert {r.conv_id: r.chat_text for r in render.chat_render(df, part_turns=5).collect()} == whole
    joined = {}
    for r in sorted(parts, key=lambda r: (r.conv_id, r.part)):
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.chat_text
    assert joined == whole
    assert whole[2] == "<|user|>\nhi<|end|>\n<|endoftext|>"


def test_verdict_stream_resumes_and_dedups(spark):
    import datetime
    d = tempfile.mkdtemp()
    ts = datetime.datetime(2024, 1, 1)

    def reply(pid, w):
        return {"comparison": "c", "prompt_id": pid, "swap": 0, "arrived_at": ts.isoformat(),
                "raw": json.dumps({"response_a_scores": {}, "response_b_scores": {}, "winner": w})}
    first = [reply(i, "A") for i in range(6)]
    second = first[:3] + [reply(i, "B") for i in range(6, 10)]      # re-delivered + new
    os.makedirs(f"{d}/in/1")
    with open(f"{d}/in/1/a.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in first))
    state, out = f"{d}/state", f"{d}/out"
    q, _ = streams.verdict_win_rates(spark, f"{d}/in/*", state_path=state, out_path=out)
    q.awaitTermination()
    os.makedirs(f"{d}/in/2")
    with open(f"{d}/in/2/b.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in second))
    q, _ = streams.verdict_win_rates(spark, f"{d}/in/*", state_path=state, out_path=out)
    q.awaitTermination()
    r = streams.latest_result(spark, out).collect()[0]
    assert r.total_pairs == 10 and r.challenger_wins == 6
    assert abs(r.win_rate_b - 0.4) < 1e-9


def test_verdict_stream_keeps_swapped_judgements_and_late_replies(spark):
    import datetime
    d = tempfile.mkdtemp()
    os.makedirs(f"{d}/in")
    body = json.dumps({"response_a_scores": {}, "response_b_scores": {}, "winner": "A"})

    def write(name, rows):
        with open(f"{d}/in/{name}.json", "w") as f:
            f.write("\n".join(json.dumps({"comparison": "c", "prompt_id": p, "swap": s, "raw": body,
                                          "arrived_at": (datetime.datetime(2024, 1, 1) + datetime.timedelta(
                                              minutes=m)).isoformat()}) for p, s, m in rows))
        os.utime(f"{d}/in/{name}.json", (1_700_000_000 + len(os.listdir(f"{d}/in")),) * 2)
    write("1", [(1, 0, 0), (1, 1, 1), (1, 0, 2)])        # both orders, one of them twice
    write("2", [(2, 0, 300)])
    write("3", [(3, 0, 310), (4, 0, 10)])                # the second is hours late
    q, out = streams.verdict_win_rates(spark, f"{d}/in", files_per_batch=1)
    q.awaitTermination()
    r = streams.latest_result(spark, out).collect()[0]
    assert r.total_pairs == 5 and r.challenger_wins == 4   # the swapped verdict went to the opponent
    assert streams.late_rows(q) == 0


def test_verdict_stream_over_many_batches(spark):
    """Copies within and beyond the time that keys are state, late first
    deliveries, a restart: the counts are those of the batch."""
    import datetime
    import random
    import time
    from tuneval.operators import verdicts as V
    rng, d, sent = random.Random(3), tempfile.mkdtemp(), []
    os.makedirs(f"{d}/in")

    def write(name, keys, minute):
        with open(f"{d}/in/{name}.json", "w") as f:
            for c, p, s in keys:
                body = {"response_a_scores": {}, "response_b_scores": {}, "winner": "AB"[p % 2]}
                r = {"comparison": c, "prompt_id": p, "swap": s, "raw": json.dumps(body) if p % 7 else "none",
                     "arrived_at": (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute + p)).isoformat()}
                sent.append(r)
                f.write(json.dumps(r) + "\n")
        os.utime(f"{d}/in/{name}.json", (1_700_000_000 + len(os.listdir(f"{d}/in")),) * 2)

    def run():
        q, _ = streams.verdict_win_rates(spark, f"{d}/in", "30 minutes", state_path=f"{d}/state", out_path=f"{d}/out",
                                         files_per_batch=1, seen_for="25 seconds")
        q.awaitTermination()
        return {r.comparison: (r.total_pairs, r.error_count, r.challenger_wins, r.win_rate_a)
                for r in streams.changed_results(spark, f"{d}/out", ["comparison"]).collect()}

    def batch():
        v = V.win_rates(V.normalize_verdicts(V.parse_verdicts(
            spark.createDataFrame(sent).dropDuplicates(["comparison", "prompt_id", "swap"]))))
        return {r.comparison: (r.total_pairs, r.error_count, r.challenger_wins, r.win_rate_a) for r in v.collect()}
    old = [("x", p, 0) for p in range(10)] + [("y", p, p % 2) for p in range(10)]
    write("1", old, 0)
    write("2", rng.sample(old, 8) + [("x", 50, 0), ("x", 50, 0)], 0)            # copies within the time
    write("3", [("x", p, 0) for p in range(60, 70)], 600)
    assert run() == batch()
    time.sleep(30)
    write("3b", [("y", 80, 0)], 600)                                            # keys leave the state with the next data
    write("4", rng.sample(old, 8) + [("y", p, 0) for p in range(11, 15)], 0)    # late copies, late first deliveries
    write("5", [("x", p, 1) for p in range(60, 70)], 600)
    assert run() == batch()
    assert spark.read.parquet(f"{d}/out_late").count() == 8
    last = spark.read.parquet(f"{d}/out").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert last[0]["count"] == 2 and last[-1]["count"] == 1                     # only changed comparisons
