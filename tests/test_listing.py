"""The listing stream against a plain loop, whatever the order in which steps arrive."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import acquisition
from leafmill.sources import sinks, tables
from leafmill.streaming import listing, manifest


@pytest.fixture(scope="module")
def stateful(spark):
    for k, v in listing.STATE_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k in listing.STATE_CONF:
        spark.conf.unset(k)


def plain(steps, only=(), limit=0):
    """One listing's steps in order, page by page."""
    out, seen, barren, given = [], set(), 0, 0
    pages = []
    for s in sorted(steps, key=lambda s: s["seq"]):
        if not pages or pages[-1][0]["page"] != s["page"]:
            pages.append([])
        pages[-1].append(s)
    for n, page in enumerate(pages):
        first = page[0]
        if n:
            if barren >= 2:
                return [*out, (first["seq"], "exhausted", "")]
            if first["cards"] and {i for i, _ in first["cards"]} <= seen:
                return [*out, (first["seq"], "all_seen", "")]
        fresh = stagnant = 0
        for k, s in enumerate(page):
            if k >= 18:
                break
            new = 0
            for i, _ in s["cards"]:
                if i in seen:
                    continue
                new += 1
                if not only or i in only:
                    if limit and given >= limit:
                        return [*out, (s["seq"], "limit", "")]
                    given += 1
                    out.append((s["seq"], "card", i))
                seen.add(i)
            fresh += new
            stagnant = 0 if new else stagnant + 1
            if stagnant >= 3 and s["at_bottom"]:
                break
        barren = 0 if fresh else barren + 1
    return out


def steps_of(r, name):
    out, known = [], 0
    for page in range(r.randrange(1, 7)):
        low = known
        size = r.choice((0, 3, 12, 40))
        for _ in range(r.randrange(1, 26)):
            pool = list(range(low, low + size)) or [0]
            ids = [] if r.random() < 0.2 else r.sample(pool, min(len(pool), r.randrange(0, 5)))
            if size == 0 and r.random() < 0.8:
                ids = [i for i in ids if i < known]
            out.append({"listing": name, "seq": len(out), "page": page, "at_bottom": r.random() < 0.5, "cards": [(f"{name}-{i}", f"label {i}") for i in ids]})
        known += size if r.random() < 0.7 else 0
    return out


def arrive(r, folder, steps, files):
    """Steps in shuffled files, some of them twice."""
    rows = [*steps, *r.sample(steps, len(steps) // 5)]
    r.shuffle(rows)
    folder.mkdir()
    for k in range(files):
        lines = [json.dumps({**s, "cards": [{"covidence_id": i, "label": t} for i, t in s["cards"]]}) for s in rows[k::files]]
        (folder / f"{k}.json").write_text("\n".join(lines))


@pytest.mark.parametrize(("only", "limit"), [((), 0), ((), 9), (("a-1", "a-2", " b-3 ", "c-30"), 0)])
def test_equals_a_plain_loop(stateful, tmp_path, only, limit):
    r = random.Random(limit + len(only))
    every = {n: steps_of(r, n) for n in "abcdef"}
    arrive(r, tmp_path / "in", [s for steps in every.values() for s in steps], 4)
    stream = stateful.readStream.schema(listing.STEP_DDL).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = listing.follow(stream, only, limit).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {n: [] for n in every}
    for x in stateful.read.schema(listing.FOUND_DDL).parquet(f"{tmp_path}/out").collect():
        got[x["listing"]].append((x["seq"], x["event"], x["covidence_id"]))
    wanted = {i.strip() for i in only}
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(plain(s, wanted, limit)) for n, s in every.items()}
    assert limit or only or {e for v in got.values() for _, e, _ in v} >= {"card"}


def fetch(i, label):
    if i.endswith("2"):
        raise OSError(f"no file for {label}")
    if i.endswith("3"):
        raise KeyError
    return {"status": "downloaded", "saved_path": f"/d/{i}.pdf", "source_filename": f"{i}.pdf", "method": "direct_fetch"}


def test_attempts(spark, tmp_path):
    """Each attempt is one row of the log, failed ones too; the log is read back by its latest rows."""
    cards = spark.createDataFrame([(f"{k}", f"card {k}") for k in range(1, 6)], "covidence_id string, label string")
    log = f"{tmp_path}/log"
    sinks.append_events(acquisition.attempts(cards, fetch), log)
    again = acquisition.to_fetch(cards, tables.latest_events(spark, log).where("status = 'downloaded'").select(F.col("covidence_id").alias("id")))
    assert [r["covidence_id"] for r in again.collect()] == ["2", "3"]
    sinks.append_events(acquisition.attempts(again, lambda i, label: {"status": "downloaded"} if i == "2" else fetch(i, label)), log)
    rows = {r["covidence_id"]: r for r in manifest.latest(spark.read.schema(schemas.MANIFEST_DDL).json(log), "covidence_id", ["finished_at_utc"]).collect()}
    assert {i: r["status"] for i, r in rows.items()} == {"1": "downloaded", "2": "downloaded", "3": "failed", "4": "downloaded", "5": "downloaded"}
    assert rows["3"]["error"] == "KeyError" and rows["3"]["method"] is None and rows["1"]["method"] == "direct_fetch" and rows["1"]["started_at_utc"] <= rows["1"]["finished_at_utc"]
    assert spark.read.text(log).count() == 7
