"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest

from . import brute

CLASH = ["own", "h1", "gone", "label", "id", "key", "part", "nth", "size", "copies", "copy", "taken_id", "document", "rank", "kept", "n", "doc_id_"]
BASE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * 7919 % 5003}x" for i in range(60_000))
LINES = "\n".join(f"this line is long enough to be counted as one {i % 3000}" for i in range(6000))
PROSE = "the old house and the road to it was on the way that was for all by this river as it is in a land from that time are at be with"


def rows_of(extra: bool):
    own = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, None), (4, PROSE, "en", "a", 5), (5, PROSE, "en", "b", 5),
        (5, PROSE, "en", "b", 5), (6, PROSE.upper(), "xx", None, 5), (None, PROSE, "en", "a", 5), (None, None, None, None, None),
        (7, LONG, "en", "a", 1), (8, LINES, "en", "c", 1), (9, LINES, "en", "c", 1), (10, "ünïcödé 日本 \x00 " + PROSE, "de", "c", 1),
    ]
    return [(*r, *["x"] * len(CLASH)) for r in own] if extra else own


@pytest.fixture(scope="module")
def tables(spark):
    extra = BASE + ", " + ", ".join(f"{c} string" for c in CLASH)
    return {"docs": spark.createDataFrame(rows_of(True), extra), "none": spark.createDataFrame([], BASE)}


def operators():
    from sigspark.llm import op1_line_dedup, op2_near_dedup, op3_packing, op4_lm, op5_quality, op6_exact_dedup, op7_pii, op9_mixing, op10_token_counts

    return {
        "op1": op1_line_dedup.dedup_lines, "op2": op2_near_dedup.near_classes, "op3": op3_packing.pack, "op4": op4_lm.model_scores, "op5": op5_quality.quality,
        "op6": op6_exact_dedup.dedup, "op7": op7_pii.find_pii, "op9": op9_mixing.mix, "op10": op10_token_counts.token_histogram,
    }


ONE_ROW_EACH = ["op1", "op2", "op4", "op5", "op6", "op7", "op9"]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10"])
def test_empty_table(tables, name):
    assert operators()[name](tables["none"]).collect() == []


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_every_row_is_answered(tables, name):
    got = operators()[name](tables["docs"]).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((r[0] or -1) for r in rows_of(False))


def test_line_dedup_edges(tables):
    got = operators()["op1"](tables["docs"]).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert (by[1]["n_lines"], by[1]["n_dropped"], by[1]["kept_sha256"]) == (1, 0, brute.sha(""))
    assert by[3]["n_lines"] == 2
    assert (by[8]["n_lines"], by[8]["n_dropped"]) == (6000, 0)  # two documents only


def test_line_dedup_drops_many_lines_of_long_texts_and_settles(spark):
    from sigspark.llm import op1_line_dedup as op

    docs = [(d, LINES + f"\nend {d}") for d in range(1, 9)] + [(8, LINES), (None, LINES)]
    got = op.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=3).collect()
    assert sorted(((r["doc_id"] or -1), r["n_lines"], r["n_dropped"]) for r in got) == sorted([(d, 6001, 6000) for d in range(1, 8)] + [(8, 6001, 0), (8, 6000, 0), (-1, 6000, 0)])
    runs = op.LineRuns(spark)
    line = "h1 long, h2 long, n_docs long, top_doc long"
    runs.add(spark.createDataFrame([(1, 1, 5, 9), (2, 2, 4, 9)], line))
    left = runs.unsettled(spark.createDataFrame([(1, 1, 1, 8), (1, 1, 1, 10), (2, 2, 1, 1), (3, 3, 1, 1)], line), 5)
    assert sorted(map(tuple, left.collect())) == [(1, 1, 1, 10), (2, 2, 1, 1), (3, 3, 1, 1)]


def test_runs_are_compacted_by_level(spark):
    from sigspark.llm import op1_line_dedup as op

    runs = op.LineRuns(spark, fan_out=2)
    for d in range(5):
        runs.add(spark.createDataFrame([(0, 0, 1, d), (d, d, 1, d)], "h1 long, h2 long, n_docs long, top_doc long").groupBy("h1", "h2").agg({"n_docs": "sum", "top_doc": "max"}).toDF("h1", "h2", "n_docs", "top_doc"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["n_docs"], r["top_doc"]) for r in runs.totals().collect()} == {(0, 6, 4), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)}


def test_runs_are_kept_and_opened_for_a_later_batch(spark, tmp_path):
    """Two batches in two openings of a folder give what one opening gives; batches meet the runs without an exchange."""
    from sigspark.llm import op1_line_dedup as op

    line = "this line is long enough to be counted as one, and it is a common one"
    docs = spark.createDataFrame([(d, f"{line}\nand this one is of document {d} alone, whatever else it has") for d in range(1, 13)], "doc_id long, text string")
    folder = f"file://{tmp_path}/runs"
    first = op.dedup_lines(docs.where("doc_id <= 6"), batches=1, runs=op.LineRuns(spark, 4, 3, folder)).collect()
    assert sum(r["n_dropped"] for r in first) == 5
    again = op.LineRuns(spark, 4, 99, folder)
    assert (len(again.levels[0]), again.buckets) == (1, 3)
    second = op.dedup_lines(docs.where("doc_id > 6"), batches=2, runs=again).collect()
    assert sorted(r["n_dropped"] for r in second) == [0, 1, 1, 1, 1, 1]
    assert {(r["n_docs"], r["top_doc"]) for r in op.LineRuns(spark, folder=folder).frequent(5).collect()} == {(12, 12)}
    keys = again.dealt(spark.createDataFrame([(1, 1, 1, 1)], "h1 long, h2 long, n_docs long, top_doc long"))
    plan = again.unsettled(keys, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1


def test_near_edges(tables):
    got = operators()["op2"](tables["docs"]).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert all(by[d]["class_id"] == d and by[d]["kept"] for d in (1, 2, 3, 7))
    assert by[4]["class_id"] == by[5]["class_id"] == by[6]["class_id"] == 10  # 27 of 30 shingles are shared
    assert (by[8]["class_id"], by[9]["class_size"]) == (9, 2)
    assert all(r["class_id"] is None and r["class_size"] == 1 and r["kept"] for r in got if r["doc_id"] is None)


def test_near_copies_of_a_long_text(spark):
    words = LONG.split()
    edited = words[:]
    edited[1000:1000:] = ["new"] * 3
    other = [w + "y" if i % 10 == 0 else w for i, w in enumerate(words)]
    from sigspark.llm.op2_near_dedup import near_classes

    got = near_classes(spark.createDataFrame([(1, LONG), (2, " ".join(edited)), (3, " ".join(other))], "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {1: 2, 2: 2, 3: 3}


def test_classes_joined_in_the_second_round(spark):
    """A chain: neighbours are similar, the ends are not."""
    words = [f"a{i}" for i in range(400)]
    from sigspark.llm.op2_near_dedup import near_classes

    chain = [(100 + k, " ".join(words[12 * k : 12 * k + 200])) for k in range(12)]
    got = near_classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["class_size"]) for r in got} == {(d, *c) for d, c in brute.classes([d for d, _ in chain], brute.near_links(chain)).items()}


def test_rows_of_one_doc_id_with_other_texts(spark):
    """Each text is a vertex; the doc_id joins them. Nothing depends on which row comes first."""
    from sigspark.llm.op2_near_dedup import near_classes

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b), (4, c), (4, None)]
    for order in (rows, rows[::-1]):
        got = near_classes(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["class_id"]) for r in got if r["class_size"] > 1} == {(1, 3), (2, 3), (3, 3)}


def test_without_the_bit_filter_no_pair_of_a_bucket_is_left_out(spark):
    from sigspark.llm.op2_near_dedup import near_classes

    words = [f"a{i}" for i in range(400)]
    chain = [(100 + k, " ".join(words[12 * k : 12 * k + 200])) for k in range(12)]
    got = near_classes(spark.createDataFrame(chain, "doc_id long, text string"), margin=None).collect()
    assert {r["class_size"] for r in got} == {12}


def test_one_bit_minima_estimate_jaccard():
    import numpy as np

    from sigspark.llm import op2_near_dedup as op

    rng = np.random.default_rng(1)
    factors = op.multipliers(op.BITS)
    for shared in (500, 889, 1000):  # of 1000 labels each
        a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared, dtype=np.uint64)])
        same = op.BITS - sum(int(x).bit_count() for x in (op.one_bit_minima(a, factors) ^ op.one_bit_minima(b, factors)).view(np.uint64))
        assert abs(same / op.BITS - (1 + shared / (2000 - shared)) / 2) < 0.06
        assert (same >= op.agreeing(0.8, op.MARGIN)) == (shared >= 889)


def test_packing_edges(tables):
    got = operators()["op3"](tables["docs"]).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    assert max(r["piece"] for r in got if r["doc_id"] == 7) > 10
    assert len([r for r in got if r["doc_id"] == 5 and r["piece"] == 0]) == 2
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096


def test_lm_edges(tables):
    got = {r["doc_id"]: r for r in operators()["op4"](tables["docs"]).collect()}
    assert (got[1]["n_tokens"], got[2]["n_tokens"], got[3]["n_tokens"], got[7]["n_tokens"]) == (1, 1, 1, 60_001)


def test_lm_beats_unigrams_on_held_out_rows(spark):
    from sigspark.llm import op4_lm

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = op4_lm.model_scores(docs).where("held_out").collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_quality_edges(tables):
    got = {r["doc_id"]: r for r in operators()["op5"](tables["docs"]).collect() if r["doc_id"]}
    assert all(got[d]["base_failed"] and not got[d]["kept"] and got[d]["n_words"] == 0 for d in (1, 2, 3))
    assert got[4]["kept"] and not got[4]["base_failed"]
    assert got[6]["common_distance"] is None
    assert got[7]["n_words"] == 60_000


def test_exact_edges(tables):
    got = operators()["op6"](tables["docs"]).collect()
    by = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"]}
    assert by[1] == (2, 3, False) and by[2] == (2, 3, True)  # the null row without an id is empty too
    assert by[4] == (6, 5, False) and by[6] == (6, 5, True)


def test_exact_tells_colliding_digests_apart(spark):
    from sigspark.llm import op6_exact_dedup as op

    docs = [(i, f"text number {i % 300}") for i in range(900)]
    got = op.dedup(spark.createDataFrame(docs, "doc_id long, text string"), digest_size=1).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (600 + i % 300, 3) for i in range(900)}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail bob [at] example [dot] com now", "email:5:31"),
        ("bob​@examрle.com", "email:0:16"),
        ("call plus four nine one seven two three four five six seven today", "phone:5:59"),
        ("clean words at noon and a dot", ""),
        ("", ""),
    ],
)
def test_disguised_spans(text, found):
    from sigspark.llm.op7_pii import all_spans, joined

    assert joined(all_spans(text)) == found


def test_chat_edges(spark):
    from sigspark.llm import op8_chat as op

    schema = "conv_id long, turn long, role string, text string, record string, layout string"
    rows = [(1, 1, "assistant", None, "x", "y"), (1, None, None, "a<|im_end|>\\b<\\|x", "x", "y"), (None, 0, "user\n", "q", "x", "y"), (2, 0, "assistant", "same", "", ""), (2, 0, "assistant", "same", "", "")]
    got = {r["conv_id"]: r for r in op.chat(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (2, brute.sha("\na<|im_end|>\\b<\\|x\nassistant\n\n"))
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 8)
    assert got[None]["turns_sha256"] == brute.sha("user\n\nq\n")
    assert op.chat(spark.createDataFrame([], schema)).collect() == []


def test_chat_layouts():
    from sigspark.llm.op8_chat import canonical_turns, format_turns, parse

    want = [("user", "q"), ("assistant", "a")]
    for record in ({"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}):
        assert canonical_turns(record)[1] == want
    assert canonical_turns({"odd": 1}) == ("unknown", None, {})
    assert parse(format_turns(want)[0]) == want
    more = {"id": 7, "messages": [{"role": "user", "content": "q", "name": "ann"}, {"role": "assistant", "content": "a"}], "tags": ["x"]}
    assert canonical_turns(more) == ("messages", want, {"id": 7, "tags": ["x"], "messages": [{"name": "ann"}, {}]})
    assert canonical_turns({"system": "s", "prompt": "q", "response": "a", "id": None})[:2] == ("system_prompt_response", [("system", "s"), *want])
    assert canonical_turns({"instruction": "q", "input": "", "output": "a", "score": 1}) == ("instruction_input", want, {"score": 1})


def test_chat_records_lose_nothing(spark):
    from sigspark.llm import op8_chat as op

    raw = ['{"prompt": "q", "response": "a", "id": 3}', '{"odd": [1, 2]}', "no json", None, '{"messages": []}', '{"messages": [{"role": "user", "content": {"parts": ["x"]}}]}']
    got = op.format_records(spark.createDataFrame(list(enumerate(raw)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [r["layout"] for r in got] == ["prompt_response", "unknown", "unknown", "unknown", "no_messages", "unknown"]
    assert got[0]["extra"] == '{"id": 3}'
    assert [op.parse(r["formatted"]) for r in got[1:4]] == [[("record", '{"odd": [1, 2]}')], [("record", "no json")], [("record", "")]]
    assert op.parse(got[5]["formatted"]) == [("record", raw[5])]


def test_chat_selects_layouts_for_the_table(spark):
    from sigspark.llm import op8_chat as op

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", ""), (2, 2, "assistant", "a"), (3, 0, "assistant", "a")]
    got = {r["conv_id"]: r for r in op.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[k]["layout"] for k in (1, 2, 3)] == ["prompt_response", "system_prompt_response", "messages"]
    assert got[2]["turns_sha256"] == brute.sha("system\ns\nuser\n\nassistant\na\n")


def test_mixing_edges(tables):
    got = operators()["op9"](tables["docs"]).collect()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_token_count_edges(tables):
    got = operators()["op10"](tables["docs"]).collect()
    assert sum(r["n_docs"] for r in got) == len(rows_of(False))
    assert {r["n_tokens"]: r["n_docs"] for r in got}[0] == 4


def test_pipeline_stages_on_edges(spark, tables, tmp_path):
    import corpus_pipeline as p

    for docs in (tables["docs"], tables["none"]):
        columns = docs.columns
        for name, stage in p.STAGES[:-1]:
            docs = p.written(stage(spark, docs, ""), name)
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        assert None not in ids and not ids & {1, 2, 3, 4, 5}
        assert p.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == len(ids)


def test_pipeline_keeps_documents_without_a_doc_id(spark):
    import corpus_pipeline as p

    prose = lambda k: " ".join(f"{w}{k}" for w in "some words of a story that nobody told before the rain had gone".split())
    rows = [(None, prose(1), "xx", "a"), (None, prose(1), "xx", "a"), (None, prose(2), "xx", None), (3, prose(3), "xx", "a"), (4, prose(2), "xx", "b"), (None, None, "xx", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "0L AS n_chars")
    stage = dict(p.STAGES)
    kept = p.written(stage["quality_rules"](spark, docs, ""), "q")
    assert kept.count() == 5
    kept = p.written(stage["exact_dedup"](spark, kept, ""), "e")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, prose(1)), (0, prose(1)), (3, prose(3)), (4, prose(2))])
    kept = p.written(stage["near_dedup"](spark, kept, ""), "n")
    assert kept.count() == 4
    mixed = p.written(stage["mixing"](spark, kept, ""), "m")
    assert {r["doc_id"] for r in mixed.collect()} == {None, 3, 4}


def test_targets_of_many_sources(spark):
    """Against the rule carried out source by source."""
    import random

    from sigspark.llm import op9_mixing as op

    rng = random.Random(4)
    for n in (1, 2, 7, 60):
        own = {f"s{rng.random()}": rng.choice([0, 1, 5, 40, 3000]) for _ in range(n)} | {None: 17}
        order = sorted(own, key=lambda k: (k is None, k or ""))
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        want, open_, left = dict.fromkeys(own, 0.0), {k for k in own if own[k]}, float(sum(own.values()))
        while open_:
            share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
            over = {k for k in open_ if share[k] > 3 * own[k]}
            want |= {k: 3.0 * own[k] for k in over} if over else share
            left, open_ = left - sum(want[k] for k in over), open_ - over if over else set()
        histogram = spark.createDataFrame([(k, v, 1) for k, v in own.items()], "source string, size long, n long").repartition(5)
        ranked = op.ranked_sources(histogram)
        assert {r["source"]: r["rank"] for r in ranked.collect()} == {k: i for i, k in enumerate(order)}
        got = {r["source"]: r["target"] for r in op.targeted(ranked, (5, 2, 1), 3).collect()}
        assert got == pytest.approx(want)


def test_mixing_of_rows_that_repeat_a_doc_id(spark):
    from sigspark.llm import op9_mixing as op

    rows = [(None, "a b c", "x")] * 3000 + [(d, "a b c", "x") for d in range(500)] + [(d, "w " * 40, "y") for d in range(500, 900)]
    got = op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 3000
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_knapsack_is_the_best_sum():
    import itertools
    import random

    from sigspark.llm.op9_mixing import knapsack

    rng = random.Random(9)
    for _ in range(200):
        items = [(rng.randrange(1, 30), rng.randrange(0, 4), i) for i in range(5)]
        budget = rng.randrange(0, 120)
        best = max(s for c in itertools.product(*[range(n + 1) for _, n, _ in items]) if (s := sum(k * x[0] for k, x in zip(c, items, strict=True))) <= budget)
        got = knapsack(items, budget)
        assert sum(items[i][0] * n for i, n in got.items()) == best and all(n <= items[i][1] for i, n in got.items())


def test_pipeline_against_brute_force(spark):
    """Exact and near groups keep one row each, the mix takes what its targets say and every copy is packed."""
    import corpus_pipeline as p
    from sigspark.llm import op5_quality, op9_mixing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r["doc_id"] for r in op5_quality.quality(docs).where("kept").collect()}
    stage = dict(p.STAGES)
    a = p.written(stage["quality_rules"](spark, docs, sf), "a")
    assert {r["doc_id"] for r in a.collect()} == clean
    b = p.written(stage["exact_dedup"](spark, a, sf), "b")
    texts = [(r["doc_id"], r["text"]) for r in a.collect()]
    assert {r["doc_id"] for r in b.collect()} == {k for k, *_ in brute.exact(texts).values()}
    c = p.written(stage["near_dedup"](spark, b, sf), "c")
    texts = [(r["doc_id"], r["text"]) for r in b.collect()]
    assert {r["doc_id"] for r in c.collect()} == {k for k, _ in brute.classes([d for d, _ in texts], brute.near_links(texts)).values()}
    d = p.written(stage["mixing"](spark, c, sf), "d")
    copies = {r["doc_id"]: r["copies"] for r in op9_mixing.mix(c).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()} == copies
    packed = stage["packing"](spark, d, sf)
    assert packed.where("piece = 0").count() == sum(copies.values())
