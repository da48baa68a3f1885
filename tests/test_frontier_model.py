"""Random sites against a plain first-in first-out visit."""

import os
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from pagetab.operators import frontier
from pagetab.operators.frontier import BLOCK, _first_targets, expand, first_mentions, numbered

from sites import ORIGIN, page, run


def random_site(rnd):
    n = rnd.randint(1, 12)
    paths = ["/"] + [f"/{'x' if rnd.random() < .2 else 'p'}{i}" for i in range(1, n)]
    routes = {"/robots.txt": (200, {"type": "text/plain"}, rnd.choice(["User-agent: *\nDisallow: /x\n", "", "User-agent: *\nDisallow:\n"]))}
    for p in paths:
        roll = rnd.random()
        if roll < .1:
            continue  # not captured
        if roll < .25:
            routes[p] = (301, {"location": rnd.choice(paths + ["https://out.example.org/", "", "/?token=1"])}, "")
        elif roll < .32:
            routes[p] = (404, {"type": "text/html"}, "gone")
        elif roll < .38:
            routes[p] = (200, {"type": "image/png"}, "img")
        else:
            links = [rnd.choice(paths + ["/missing", "https://out.example.org/", "http://[", "#f"]) for _ in range(rnd.randint(0, 8))]
            routes[p] = page(links)
    limits = {"max_pages": rnd.randint(1, 14), "max_requests": rnd.randint(1, 14), "max_candidates": rnd.randint(1, 14)}
    return routes, limits


def visit(routes, limits):
    """Expected (records, excluded, attempts, remaining, stop) of one site, one URL at a time."""
    rules = [line.split(": ")[1] for line in routes["/robots.txt"][2].split("\n") if line.startswith("Disallow: ")]
    waiting, known, records, excluded = deque([("/", 0)]), {"/"}, [], Counter()
    attempts, full = 0, False

    def mention(target, depth):
        nonlocal full
        if target.startswith("https://out."):
            excluded["outside_origin"] += 1
        elif "[" in target or "token" in target:
            excluded["invalid_or_sensitive_url"] += 1
        elif target in known:
            excluded["duplicate_url"] += 1
        elif len(known) >= limits["max_candidates"]:
            excluded["max_candidates"] += 1
            full = True
        else:
            known.add(target)
            waiting.append((target, depth))

    stop = None
    while waiting:
        if attempts + 1 >= limits["max_requests"]:
            stop = "max_requests"
            break
        if attempts >= limits["max_pages"]:
            stop = "max_pages"
            break
        path, depth = waiting.popleft()
        if any(path.startswith(r) for r in rules):
            records.append((path, "blocked_robots", None))
            continue
        attempts += 1
        if path not in routes:
            records.append((path, "download_error", None))
            continue
        status, headers, body = routes[path]
        if status == 301:
            to = headers["location"]
            records.append((path, "redirect", depth))
            if to and not to.startswith("https://out.") and "token" not in to:
                mention(to, depth)
        elif status == 404:
            records.append((path, "http_error", depth))
        elif headers["type"] == "image/png":
            records.append((path, "unsupported_content", depth))
        else:
            records.append((path, "document", depth))
            for piece in body.split('<a href="')[1:]:
                to = piece.split('"')[0]
                mention(path if to == "#f" else to, depth + 1)
    return records, dict(excluded), attempts, len(waiting), stop or ("max_candidates" if full else "frontier_exhausted")


@pytest.mark.parametrize("block", [2, BLOCK])
def test_random_sites(spark, block):
    """Blocks of a few links, and of whole sites."""
    rnd = random.Random(17)
    sites = {f"s{i}": random_site(rnd) for i in range(400)}
    ran = run(spark, sites, block=block)
    records = {}
    for r in ran.records.orderBy("crawl_id", "seq").collect():
        records.setdefault(r.crawl_id, []).append((r.url.removeprefix(ORIGIN), r.kind, r.depth))
    for r in ran.reports.collect():
        want = visit(*sites[r.crawl_id])
        got = (records.get(r.crawl_id, []), r.excluded_link_counts, r.document_attempts, r.remaining_candidates, r.stop_reason)
        assert got == want, sites[r.crawl_id]
    assert ran.frontier.groupBy("crawl_id", "url").count().where("count > 1").count() == 0


def test_numbering_a_hot_crawl(spark):
    rows = spark.range(50_000).select(
        F.lit("hot").alias("crawl_id"), F.concat(F.lit("u"), F.pmod(F.col("id") * 7919, F.lit(30_000))).alias("url"),
        (F.col("id") % 3).alias("parent_seq"), F.col("id").alias("pos"))
    firsts = first_mentions(rows)
    got = numbered(firsts, F.lit(1000)).orderBy("rank").collect()
    best = {}
    for r in rows.collect():
        best[r.url] = min(best.get(r.url, (9, 0)), (r.parent_seq, r.pos))
    want = sorted((v, u) for u, v in best.items())[:1000]
    assert [((r.parent_seq, r.pos), r.url, r.rank) for r in got] == [(v, u, i + 1) for i, (v, u) in enumerate(want)]
    assert sum(r.mentions for r in firsts.collect()) == 50_000


def test_numbered_crawls_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("concat('c', id % 2) AS crawl_id", "id AS parent_seq", "id AS pos")
    plan = numbered(rows, F.lit(5))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def links(spark, rows):
    return spark.createDataFrame(rows, "crawl_id string, src_url string, pos long, url string, deeper int")


def starts(spark, crawls, most=10_000):
    return spark.createDataFrame([(c, f"{ORIGIN}/0", 1000, 2000, most) for c in crawls], "crawl_id string, start_url string, max_pages int, max_requests int, max_candidates int")


NO_RULES = "crawl_id string, prefix string, seq int, allow boolean"


def test_long_chain_of_pages_with_many_links(spark, tmp_path):
    """1,000 pages in a line, each with 220 links beside: more than the links of a block, and a job for each page would take long."""
    side = spark.range(1000).selectExpr("id", "explode(sequence(0, 219)) AS k")
    rows = side.selectExpr(
        "'long' AS crawl_id", f"concat('{ORIGIN}/', id) AS src_url", "CAST(k AS long) AS pos",
        f"CASE WHEN k = 110 THEN concat('{ORIGIN}/', id + 1) ELSE concat('{ORIGIN}/x', (id * 7 + k) % 2000) END AS url", "1 AS deeper")
    found = expand(starts(spark, ["long"]), spark.createDataFrame([], NO_RULES), rows, str(tmp_path))
    got = {r.url: r for r in found.collect()}
    queue, known = [f"{ORIGIN}/0"], {f"{ORIGIN}/0"}
    for at, url in enumerate(queue):
        name = url.removeprefix(ORIGIN + "/")
        if at < 1000 and not name.startswith("x") and int(name) < 1000:
            for k in range(220):
                to = f"{ORIGIN}/{int(name) + 1}" if k == 110 else f"{ORIGIN}/x{(int(name) * 7 + k) % 2000}"
                if to not in known and len(queue) < 10_000:
                    known.add(to)
                    queue.append(to)
    assert sorted(got, key=lambda u: got[u].seq) == queue and sum(r.processed for r in got.values()) == 1000


def test_a_round_reads_what_it_waits_for(spark, tmp_path):
    """Wide crawls of several blocks: as many rounds as levels at most, later rounds without the crawls that have ended."""
    rows = [("wide", f"{ORIGIN}/0", i, f"{ORIGIN}/a{i}", 1) for i in range(300)]
    rows += [("wide", f"{ORIGIN}/a{i}", k, f"{ORIGIN}/b{(i * 31 + k) % 900}", 1) for i in range(300) for k in range(20)]
    rows += [("wide", f"{ORIGIN}/b{i}", 0, f"{ORIGIN}/c{i}", 1) for i in range(900)]
    rows += [("small", f"{ORIGIN}/0", 0, f"{ORIGIN}/1", 1)]
    got = [
        expand(starts(spark, ["wide", "small", "none"]), spark.createDataFrame([], NO_RULES), links(spark, rows), f"{tmp_path}/{b}", block=b, ahead=1)
        for b in (64, 1 << 20)]
    one, two = ({(r.crawl_id, r.url): (r.seq, r.depth, r.discovered_from, r.processed, r.wave) for r in g.collect()} for g in got)
    assert one == two and {k: sum(c == k for c, _ in one) for k in ("wide", "small", "none")} == {"wide": 1851, "small": 2, "none": 1}
    rounds = [spark.read.parquet(f"{tmp_path}/64/round-{k}") for k in range(1, 1 + sum(x.startswith("round-") for x in os.listdir(f"{tmp_path}/64")) - 1)]
    assert 2 <= len(rounds) <= 4
    assert {r.crawl_id for r in rounds[-1].collect()} == {"wide"}


def test_a_full_queue_reads_no_more_links(spark, tmp_path):
    """The first page fills the queue; the others lead on, but what they lead to finds no room and is not read."""
    rows = [("full", f"{ORIGIN}/0", i, f"{ORIGIN}/a{i}", 1) for i in range(200)]
    rows += [("full", f"{ORIGIN}/a{i}", k, f"{ORIGIN}/b{i}-{k}", 1) for i in range(200) for k in range(20)]
    found = expand(starts(spark, ["full"], most=100), spark.createDataFrame([], NO_RULES), links(spark, rows), str(tmp_path), block=64, ahead=1)
    got = sorted((r.seq, r.url.removeprefix(ORIGIN), r.depth, r.processed) for r in found.collect())
    assert got == [(1, "/0", 0, True)] + [(i + 2, f"/a{i}", 1, True) for i in range(99)]
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("round-")) == ["round-0", "round-1"]


def test_first_targets_of_a_page(spark):
    """The first link to each target in order of place, no place last, and no more targets than may be candidates."""
    rows = [("c", "p", 5, "u", 1), ("c", "p", 2, "u", 0), ("c", "p", 2, "t", 1), ("c", "p", 2, "s", 1), ("c", "p", None, "r", 1), ("c", "q", 9, "r", 1)]
    rows += [("d", "p", i, f"u{i // 2:04d}", 1) for i in range(3000)]
    most = F.when(F.col("crawl_id") == "c", 4).otherwise(1000)
    got = {tuple(r) for r in _first_targets(links(spark, rows).withColumn("max_candidates", most)).select("crawl_id", "src_url", "pos", "url", "deeper").collect()}
    want = {("c", "p", 2, "u", 0), ("c", "p", 2, "t", 1), ("c", "p", 2, "s", 1), ("c", "p", None, "r", 1), ("c", "q", 9, "r", 1)}
    assert got == want | {("d", "p", 2 * i, f"u{i:04d}", 1) for i in range(1000)}


def test_rounds_take_no_links_beyond_a_full_queue(spark, tmp_path, monkeypatch):
    """Where the waited pages fill the queue, their first targets are all that a round takes; else it takes the blocks as well."""
    u = lambda i: f"{ORIGIN}/{i}"
    rows = [(c, u(0), i, u(1 + i // 2), 1) for c in "ab" for i in range(60)]
    rows += [(c, u(k), i, u(100 * k + i), 1) for c in "ab" for k in range(1, 31) for i in range(40)]
    taken, plain = [], frontier._round

    def counted(state, waiting, in_hand, *rest):
        taken.append({tuple(r) for r in in_hand.groupBy("crawl_id").count().collect()})
        return plain(state, waiting, in_hand, *rest)

    monkeypatch.setattr(frontier, "_round", counted)
    both = starts(spark, "a", 20).unionByName(starts(spark, "b", 100))
    got = expand(both, spark.createDataFrame([], NO_RULES), links(spark, rows), str(tmp_path)).orderBy("crawl_id", "seq").collect()
    assert taken == [{("a", 20), ("b", 30 + 30 * 40)}]
    first = [(u(0), None)] + [(u(1 + i), u(0)) for i in range(30)]
    assert [(r.url, r.discovered_from) for r in got if r.crawl_id == "a"] == first[:20]
    assert [(r.url, r.discovered_from) for r in got if r.crawl_id == "b"] == first + [(u(100 + i), u(1)) for i in range(40)] + [(u(200 + i), u(2)) for i in range(29)]


def test_waited_pages_are_taken_in_order(spark, tmp_path, monkeypatch):
    """Pages that wait in the second round lead to the same targets: each counts where it is met first."""
    u = lambda i: f"{ORIGIN}/{i}"
    rows = [("c", u(0), i, u(1 + i), 1) for i in range(5)] + [("c", u(1 + k), -i, u(50 + 10 * k + i), 1) for k in range(5) for i in range(30)]
    taken, plain = [], frontier._round

    def counted(state, waiting, in_hand, *rest):
        taken.append(in_hand.count())
        return plain(state, waiting, in_hand, *rest)

    monkeypatch.setattr(frontier, "_round", counted)
    got = expand(starts(spark, "c", 45), spark.createDataFrame([], NO_RULES), links(spark, rows), str(tmp_path), buckets=64, block=1, ahead=1).orderBy("seq").collect()
    want = [u(i) for i in range(6)] + [u(50 + i) for i in reversed(range(30))] + [u(60 + i) for i in reversed(range(20, 30))][:9]
    assert [r.url for r in got] == want
    assert max(taken) <= 45 + 30
