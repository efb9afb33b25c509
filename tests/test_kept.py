"""Tables kept over runs: bounded files, repeated runs, any split, keys that stay unique."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import provenance as PV
from tidemark.session import delete, entries, fresh_path
from tidemark.sources.generations import Generations
from tidemark.streaming import jobs, unique

DELIVERY = "event_id bigint, user_id bigint, event_type string, day date, delivery bigint, ts timestamp_ntz, value double"


def deliveries(n, seed=1):
    rnd, out = random.Random(seed), []
    for i in range(n):
        at = dt.datetime(2024, 1, 1 + rnd.randrange(3), rnd.randrange(24))
        out.append((i, rnd.randrange(3), "k", at.date(), i, at, float(rnd.randrange(100))))
    return out


def replaced(rows):
    """Value each publication replaces, one by one."""
    current, out = {}, []
    for event_id, user, kind, day, _, _, value in rows:
        out.append((event_id, current.get((user, kind, day)), (user, kind, day) in current))
        current[user, kind, day] = value
    return sorted(out)


def files_of(spark, path):
    names = entries(spark, path)
    return sum(files_of(spark, f"{path}/{n}") if "." not in n and not n.startswith("_") else n.startswith("part-") for n in names)


def publish(spark, rows, size, repeat=()):
    out = fresh_path(spark, "kept")
    store, counts = jobs.current_values(spark, out, every=3), []
    for run in range(0, -(-len(rows) // size)):
        batch = spark.createDataFrame(rows[run * size:(run + 1) * size], DELIVERY).coalesce(1)
        for _ in range(2 if run in repeat else 1):
            jobs.publish(store, batch, out, run)
        counts.append(files_of(spark, store.path))
    published = spark.read.parquet(f"{out}/published").select("event_id", "old_value", "revision_flag").collect()
    return sorted(map(tuple, published)), counts


def test_current_values_stay_small_and_exact(spark):
    rows = deliveries(56)
    got, counts = publish(spark, rows, 4, repeat=(3, 4, 9))
    assert got == replaced(rows)
    assert publish(spark, rows, 28)[0] == got
    assert max(counts) <= 3 * (1 + 4)  # three days: a base and at most four deltas of a file each


def test_repeating_a_merged_run_changes_nothing(spark):
    store = Generations(spark, fresh_path(spark, "store"), ["k"], "k string, v bigint", "p", "int", every=2)
    for run in range(5):
        store.tidy(run)
        store.add(spark.createDataFrame([("a", run, run % 2), (f"x{run}", run, 0)], "k string, v bigint, p int"), run)
    assert store.settled(3) and not store.settled(4)
    before = sorted(map(tuple, store.newest(5).collect()))
    store.tidy(4)
    assert sorted(map(tuple, store.newest(5).collect())) == before
    assert dict((k, v) for k, v, _ in before) == {"a": 4, "x0": 0, "x1": 1, "x2": 2, "x3": 3, "x4": 4}
    assert len([n for n in entries(spark, f"{store.path}/delta") if "=" in n]) == 1


def test_unfinished_merge_is_done_again(spark):
    store = Generations(spark, fresh_path(spark, "store"), ["k"], "k string, v bigint", "p", "int", every=2)
    for run in range(2):
        store.add(spark.createDataFrame([("a", run, 0)], "k string, v bigint, p int"), run)
    spark.createDataFrame([("a", 77, 0)], "k string, v bigint, p int").write.partitionBy("p").parquet(f"{store.path}/base/generation=1")
    delete(spark, f"{store.path}/base/generation=1/_SUCCESS")  # as a lost driver leaves it
    assert store.merged() == -1 and [r.v for r in store.newest(2).collect()] == [1]
    store.tidy(2)
    assert store.merged() == 1 and [r.v for r in store.newest(2).collect()] == [1]


def test_trails_equal_whole_recomputation(spark):
    rnd = random.Random(3)
    keys = [("G", c, str(y)) for c in "ABC" for y in (2000, 2001)]
    at = dt.datetime(2024, 1, 1)
    figures = [(i, *keys[i % 5], float(i), "PCT", "S", 90.0, at, at + dt.timedelta(days=rnd.randrange(9))) for i in range(30)]
    names = "record_id bigint, indicator_code string, country_code string, period string, value double, standard_unit string, source_code string, dq_score double, crawled_at timestamp_ntz, promoted_at timestamp_ntz"
    gold = spark.createDataFrame(figures, names)
    looks = [[(*rnd.choice(keys), rnd.choice(["chatbot", "api", "page"])) for _ in range(20)] for _ in range(4)]
    accesses = [spark.createDataFrame(x, "indicator_code string, country_code string, period string, access_type string") for x in looks]
    store = PV.trail_store(spark, fresh_path(spark, "trails"), every=2)
    for run, rows in enumerate([gold, gold.limit(0), gold.where("record_id > 12"), gold.where("record_id < 12")]):
        for _ in range(2):
            PV.update_trails(store, rows, accesses[run], run)
    PV.update_trails(store, gold, accesses[0], 0)
    whole = accesses[0].unionByName(accesses[1]).unionByName(accesses[2]).unionByName(accesses[3])
    assert sorted(map(str, PV.stored_trails(store, 4).collect())) == sorted(map(str, PV.citation_trails(gold, whole).collect()))
    one = accesses[1].limit(1)
    touched = one.select(F.pmod(F.xxhash64(*PV.TRAIL_KEY), F.lit(PV.TRAIL_BUCKETS)).alias("b")).head().b
    PV.update_trails(store, gold.limit(0), one, 5)
    folders = [n for n in entries(spark, f"{store.path}/delta/generation=5") if "=" in n]
    assert folders in ([f"bucket={touched}"], [])  # none if the key is unknown


@pytest.mark.parametrize("bits", [unique.BITS, 8])
def test_keys_stay_unique_for_good(spark, bits):
    # Eight bits are full at once: every key is looked up.
    store = unique.UniqueKeys(spark, fresh_path(spark, "unique"), every=2, buckets=4, bits=bits)
    seen, rnd = set(), random.Random(5)
    for run in range(5):  # deliveries may lie any time apart: no clock is involved
        rows = [(f"http://{rnd.randrange(60)}", run * 100 + i) for i in range(25)] + [(None, run)]
        frame = spark.createDataFrame(rows, "url string, n bigint")
        want, fresh = [(None, run)], set()
        for url, n in sorted(rows[:-1], key=lambda r: r[1]):
            if url not in seen | fresh:
                fresh.add(url)
                want.append((url, n))
        for _ in range(2 if run == 3 else 1):
            got = unique.first_ever(store, frame, "url", ["n"], run)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        seen |= fresh
    assert store.keys.newest(5).count() == len(seen)


def test_filters_spare_most_reads(spark):
    store = unique.UniqueKeys(spark, fresh_path(spark, "unique"))
    old = spark.range(3000).select(F.concat(F.lit("old"), "id").alias("id"))
    new = spark.range(3000).select(F.concat(F.lit("new"), "id").alias("id"))
    assert store.accept(old, 0).count() == 3000
    asked = store.maybe(store.placed(new.unionByName(old.limit(5))), 1).where("maybe")
    assert 5 <= asked.count() < 35


def test_content_changes_over_batches(spark):
    out = fresh_path(spark, "changes")
    store = jobs.last_hashes(spark, out, every=2)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 11 == 0 else 1 if i % 3 else i % 5, None if i % 17 == 0 else "ab"[i * i % 7 % 2], day + dt.timedelta(minutes=i * 13 // 2)) for i in range(240)]
    log = spark.createDataFrame(rows, "log_id bigint, source_code bigint, content_hash string, logged_at timestamp_ntz")
    for run in [0, 1, 1, 2, 3, 3, 4, 2, 5]:  # with replays, also of a run that is merged already
        jobs.judge_changes(store, log.where(F.col("log_id").between(run * 40, run * 40 + 39)), out, run)
    last, want = {}, {}
    for i, source, digest, _ in rows:
        want[i] = "SKIP" if digest is not None and last.get(source) == digest else "PROCEED"
        last[source] = digest
    got = {r.log_id: r.decision for r in spark.read.parquet(f"{out}/changes").collect()}
    assert got == want and set(got.values()) == {"SKIP", "PROCEED"}
    assert not os.path.exists(f"{out}/work")
