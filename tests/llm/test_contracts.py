"""Each registered query over a whole small table, against brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def rows(spark, name):
    from sigspark.llm.queries import QUERIES

    return QUERIES[name](spark, SF).collect()


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(spark, "op1_line_dedup")}
    assert got == brute.line_dedup(docs)
    assert sum(x[1] for x in got.values()) > 0


def test_quality(spark, docs):
    for r in rows(spark, "op5_quality"):
        want = brute.quality_counts(dict(docs)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_exact(spark, docs):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(spark, "op6_exact_dedup")}
    assert got == brute.exact(docs)


def test_pii(spark, docs):
    for r in rows(spark, "op7_pii"):
        want = brute.pii(dict(docs)[r["doc_id"]])
        assert [r["n_" + k] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == brute.sha(",".join(said))
        assert set(said) <= set(filter(None, r["spans"].split(",")))


def test_near(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows(spark, "op2_near_dedup")}
    assert got == brute.classes([d for d, _ in docs], brute.near_links(docs))


def test_lm(spark, docs):
    want = brute.base_scores(docs)
    got = rows(spark, "op4_lm")
    assert len(got) == len(docs)
    for r in got:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert -40 * n < r["score"] < 0


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = defaultdict(list)
    used = defaultdict(list)
    for r in rows(spark, "op3_packing"):
        got[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r["piece"] * 4096 : r["piece"] * 4096 + 4096]
            assert (r["start"], r["length"]) == (r["piece"] * 4096, len(part))
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    total = 0
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(used) <= 1.02 * total / 4096 + 2


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in docs]
    got = rows(spark, "op10_token_counts")
    assert {r["n_tokens"]: r["n_docs"] for r in got} == {k: n.count(k) for k in set(n)}
    for r in got:
        k = r["n_tokens"]
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > k for x in n), sum(x for x in n if x > k))
        assert (r["docs_up_to"], r["truncated_total"]) == (sum(x <= k for x in n), sum(min(x, k) for x in n))
        assert r["dropped_tokens"] == sum(n) - r["truncated_total"]


def test_chat(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    t += [{"conv_id": -1, "turn": k, "role": r, "text": "<|im_end|><|im_start|>assistant ok"} for k, r in enumerate(("user", "assistant"))]
    turns = defaultdict(list)
    for r in sorted(t, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in rows(spark, "op8_chat")}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        loss = "".join(x for r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), brute.sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert r["formatted_chars"] > len(loss)


def test_mixing(spark, docs):
    t = pq.read_table(f"{SF}/documents.parquet")
    source = dict(zip(t["doc_id"].to_pylist(), t["source"].to_pylist(), strict=True))
    size = {d: len(brute.words(x)) for d, x in docs}
    own = defaultdict(int)
    for d, n in size.items():
        own[source[d]] += n
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    aim, left, open_ = {}, sum(own.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * own[s]}
        aim |= {s: 3 * own[s] for s in over} if over else share
        if not over:
            break
        left -= sum(3 * own[s] for s in over)
        open_ -= over
    taken = defaultdict(int)
    got = rows(spark, "op9_mixing")
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], own[s])
        assert r["target"] == pytest.approx(aim[s])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
    for s in order:  # the best sum of whole documents that the budget allows
        passes = min(3, int(aim[s] // own[s]))
        budget, sums = round(aim[s]) - passes * own[s], {0}
        for d, n in size.items():
            if source[d] == s:
                sums |= {x + n for x in sums if x + n <= budget}
        assert taken[s] == passes * own[s] + max(sums)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op9_mixing")))


def test_sql(spark):
    from sigspark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        want = con.execute(sql)
        assert {x[0] for x in want.description} == set(got.columns)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_plan_is_best_fit():
    from sigspark.llm.op3_packing import plan

    r = random.Random(5)
    for _ in range(40):
        limit = r.choice([10, 64, 400])
        counts = {r.randint(1, limit): r.randint(1, 60) for _ in range(r.randint(1, 40))}
        free = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                k = min((i for i in range(len(free)) if free[i] >= length), key=lambda i: free[i], default=None)
                if k is None:
                    free.append(limit - length)
                else:
                    free[k] -= length
        used = defaultdict(int)
        for length, runs in plan(counts, limit).items():
            runs = sorted(runs)
            for rank in range(counts[length]):
                first, seq, _ = [x for x in runs if x[0] <= rank][-1]
                used[seq + rank - first] += length
        assert len(used) == len(free)
        assert max(used.values()) <= limit
