import random
import re
from concurrent.futures import ThreadPoolExecutor

import tiktoken
from conftest import frame, words
from pyspark.sql import functions as F

from tessera.llm import token_counts as C
from tessera.llm.common import scratch
from tessera.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
ENCODING = tiktoken.Encoding("test", pat_str=C.PATTERN, mergeable_ranks=C.read_ranks(FILE), special_tokens={})


def expected(rows):
    out = {}
    for source, lang, text, sign in rows:
        have = out.setdefault((source, lang, "v1"), [0, 0, 0])
        for k, n in enumerate((1, len(ENCODING.encode_ordinary(text or "")), len((text or "").encode()))):
            have[k] += sign * n
    return sorted(((*k, *v) for k, v in out.items() if any(v)), key=str)


def totals(rollup):
    return sorted(map(tuple, rollup.totals().collect()), key=str)


def make(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", rng.choice(["en", "de", None]), rng.choice([words(rng, 20), None, "", "ünï \U0001F600"]), 1) for _ in range(60)]
    return rows, lambda r: spark.createDataFrame(r, "source string, lang string, text string, sign int")


def test_inserts_deletes_and_revisions(spark):
    rows, df = make(spark)
    rollup = C.Rollup(spark, scratch(spark, "rollup"))
    assert totals(rollup) == []
    count = lambda r: C.count(df(r), FILE, "v1", sign="sign")
    assert rollup.commit("load", count(rows)) and totals(rollup) == expected(rows)
    gone = [(*r[:3], -1) for r in rows[:10]]
    assert rollup.commit("delete", count(gone)) and totals(rollup) == expected(rows + gone)
    old, new = rows[10:12], [(r[0], r[1], "revised text", 1) for r in rows[10:12]]
    assert rollup.commit("revise", *C.revision(count(old), count(new)))
    assert totals(rollup) == expected(rows + gone + [(*r[:3], -1) for r in old] + new)
    everything = rows[12:] + new
    rollup.commit("clear", count([(*r[:3], -1) for r in everything]))
    assert totals(rollup) == []


def test_a_batch_counts_once(spark):
    rows, df = make(spark)
    path = scratch(spark, "rollup")
    count = C.count(df(rows), FILE, "v1")
    assert C.Rollup(spark, path).commit("b/1", count)
    assert not C.Rollup(spark, path).commit("b/1", count)
    assert C.Rollup(spark, path).commit("b/2") and totals(C.Rollup(spark, path)) == expected(rows)


def test_racing_writers_of_a_batch(spark, monkeypatch):
    """All pass the first look before any of them books; one books."""
    rows, df = make(spark)
    path, count = scratch(spark, "rollup"), C.count(df(rows), FILE, "v1")
    monkeypatch.setattr(C.Rollup, "committed", lambda self, batch_id: False)
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda _: C.Rollup(spark, path).commit("load", count), range(3)))
    assert sum(won) == 1 and totals(C.Rollup(spark, path)) == expected(rows)
    assert len(C.Rollup(spark, path)._folder.names("data")) == 1


def test_compaction_changes_no_total_and_keeps_names(spark):
    rows, df = make(spark)
    rollup = C.Rollup(spark, scratch(spark, "rollup"))
    count = lambda r: C.count(df(r), FILE, "v1")
    assert rollup.compact() and totals(rollup) == []
    rollup.commit("a", count(rows[:30]))
    rollup.commit("b", count(rows[30:]))
    assert rollup.compact() and totals(rollup) == expected(rows)
    assert not rollup.commit("a", count(rows)) and rollup.commit("c", count(rows[:5]))
    assert totals(rollup) == expected(rows + rows[:5])
    assert rollup.compact() and totals(rollup) == expected(rows + rows[:5])


def test_the_registered_history_against_brute_force(spark):
    from tessera.llm.queries import op7_token_counts

    sf = "/root/testdata/sf0.001"
    docs = [(r.source, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    multi = tiktoken.Encoding("multi", pat_str=C.PATTERN, mergeable_ranks=C.read_ranks(FILE.replace("byte_bpe_50k", "byte_bpe_multi_50k")), special_tokens={})
    want = {}
    for source, lang, text in docs:
        revised = re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip(" ")
        for version, t, encoder in (("byte_bpe_50k", revised, ENCODING), ("byte_bpe_multi_50k", text or "", multi)):
            if version == "byte_bpe_multi_50k" or lang != "es":
                have = want.setdefault((source, lang, version), [0, 0, 0])
                for k, n in enumerate((1, len(encoder.encode_ordinary(t)), len(t.encode()))):
                    have[k] += n
    assert sorted(map(tuple, op7_token_counts(spark, sf).collect()), key=str) == sorted(((*k, *v) for k, v in want.items()), key=str)


def test_a_failed_batch_leaves_nothing(spark):
    rows, df = make(spark)
    rollup = C.Rollup(spark, scratch(spark, "rollup"))
    bad = C.count(df(rows), FILE, "v1").withColumn("n_docs", F.raise_error(F.lit("lost")).cast("bigint"))
    try:
        rollup.commit("load", bad)
    except Exception:
        pass
    assert not rollup.committed("load") and totals(rollup) == []
    assert rollup.commit("load", C.count(df(rows), FILE, "v1")) and totals(rollup) == expected(rows)


def test_odd_rows_and_empty_table(spark, odd, clashing, empty, odd_rows):
    got = sorted(map(tuple, C.count(odd, FILE, "v1").collect()), key=str)
    assert got == expected([(f"src{k % 5}", "en", t, 1) for k, (_, t) in enumerate(odd_rows)])
    assert got == sorted(map(tuple, C.count(clashing, FILE, "v1").collect()), key=str)
    assert C.count(empty, FILE, "v1").collect() == []
    assert C.count(frame(spark, [(1, "<|endoftext|>")]), FILE, "v1").first().n_tokens == len(ENCODING.encode_ordinary("<|endoftext|>"))
