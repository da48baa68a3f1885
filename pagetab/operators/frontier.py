"""Bounded frontier expansion over captured pages, for any number of crawls at once.

A crawl visits URLs first in, first out, up to a budget of pages and of candidates that its
policy bounds. Its links may be many more. They are laid out once in buckets by the page
they start from, and a crawl's buckets are grouped to blocks of about equal size. The
crawls advance in rounds, all open ones together. A round reads, for each of them, the
links of the pages that it waits for and the whole blocks that the foremost of these lie
in. A crawl then follows its queue for as many hops as the links in hand allow, and what
it still waits for is left to the next round. So a crawl of one block ends in one round
however deep it is, a wide one needs a round for each level at most, and a round reads
the buckets that it waits for and the state of the crawls that are still open.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pagetab.functions.urls import MAX_URL_CHARS, request_url
from pagetab.operators.classify import BAD_ENCODING, NOT_CAPTURED
from pagetab.operators.robots import robots_verdicts, rule_chains
from pagetab.sources.shared import dropped, written

#: Links of one block of a crawl, about, and the blocks that a round reads whole.
BLOCK, AHEAD = 1 << 16, 8

#: Most candidates that a policy may allow.
MOST_CANDIDATES = 10_000

#: Columns of a document row.
DOCUMENT = ("title", "title_missing", "text", "text_truncated", "content_sha256")

def first_mentions(mentions: DataFrame, *carried: str) -> DataFrame:
    """The first mention of every (crawl_id, url) by (parent_seq, pos), with the number of mentions.

    Aggregated before the shuffle: a URL that every page links to costs one row per task.
    """
    order = F.struct("parent_seq", "pos", *carried)
    return (
        mentions.groupBy("crawl_id", "url")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("mentions"))
        .select("crawl_id", "url", "first.*", "mentions")
    )


def group_limits(spark: SparkSession, most: int = MOST_CANDIDATES) -> None:
    """Let the optimizer cut numbered groups to ``most`` rows before they are shuffled; its default stops at 1,000."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(name)) < most:
        spark.conf.set(name, str(most))


def numbered(rows: DataFrame, limit: Column, most: int = MOST_CANDIDATES) -> DataFrame:
    """Number rows of each crawl from 1 by (parent_seq, pos) and keep those up to ``limit``.

    ``limit`` is a per-crawl column of ``rows``, at most ``most``. The constant
    bound lets every task keep a crawl's first ``most`` rows only, before the shuffle, so
    that a crawl with all rows brings tasks x ``most`` of them to its window.
    """
    group_limits(rows.sparkSession, most)
    in_crawl = F.row_number().over(W.partitionBy("crawl_id").orderBy("parent_seq", "pos"))
    first = rows.withColumn("_limit", limit).withColumn("rank", in_crawl).where(F.col("rank") <= most)
    return first.where(F.col("rank") <= F.col("_limit")).drop("_limit")


def cap_candidates(firsts: DataFrame) -> DataFrame:
    """Admit distinct URLs in order of first mention until the crawl's room is used up.

    ``firsts`` are rows of ``first_mentions`` not seen before, with ``taken`` (URLs
    already admitted) and ``max_candidates``; adds the crawl-wide number ``seq``.
    """
    room = F.col("max_candidates") - F.col("taken")
    return numbered(firsts, room).withColumn("seq", F.col("taken") + F.col("rank")).drop("rank")


def spend_budget(wave: DataFrame) -> DataFrame:
    """Add ``processed`` and ``aborts``: which candidates of a wave the budget reaches.

    A candidate is reached while the requests before it stay below the budget;
    blocked ones cost nothing. A URL too long once it is percent-encoded may not
    be requested and ends the crawl. The window covers one crawl's wave, at most
    the candidate limit.
    """
    before = W.partitionBy("crawl_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    costs = (~F.col("blocked")).cast("bigint")
    spent = F.col("attempts_before") + F.coalesce(F.sum(costs).over(before), F.lit(0))
    too_long = ~F.col("blocked") & (F.length("request_url") > MAX_URL_CHARS)
    stopped = F.coalesce(F.max(too_long).over(before), F.lit(False))
    return (
        wave.withColumn("processed", (spent < F.col("page_budget")) & ~stopped)
        .withColumn("aborts", F.col("processed") & too_long)
    )


def page_budget(max_pages: Column, max_requests: Column) -> Column:
    """Page requests a crawl can make; the robots file takes one request."""
    return F.least(max_pages, max_requests - 1)


def edges(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Where each page leads: admitted links of documents, and in-scope redirects.

    A link target lies one level deeper, a redirect target does not.
    """
    from_links = links.where(F.col("url").isNotNull()).select(
        "crawl_id", "src_url", F.col("pos").cast("bigint").alias("pos"), "url", F.lit(1).alias("deeper")
    )
    from_redirects = outcomes.where(F.col("redirect_to").isNotNull()).select(
        "crawl_id", F.col("url").alias("src_url"), F.lit(0).cast("bigint").alias("pos"),
        F.col("redirect_to").alias("url"), F.lit(0).alias("deeper"),
    )
    return from_links.unionByName(from_redirects)


#: Rows of a crawl's queue as they are kept between rounds.
_QUEUE = {
    "crawl_id": "string", "url": "string", "request_url": "string", "discovered_from": "string", "depth": "int", "seq": "bigint",
    "wave": "int", "blocked": "boolean", "processed": "boolean", "aborts": "boolean", "page_budget": "int", "max_candidates": "int",
    "blocks": "bigint", "open": "boolean", "waits": "boolean",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
_STATE = pa.schema([(n, _ARROW[t]) for n, t in _QUEUE.items()])


def _block(page_url: str) -> Column:
    """The block of a page: the last bits of its hash, as many as its crawl has blocks for."""
    return F.pmod(F.xxhash64(page_url), F.col("blocks"))


def _blocks(links: DataFrame, block: int) -> DataFrame:
    """(crawl_id, blocks): into how many blocks a crawl's links are divided, a power of two."""
    powers = F.ceil(F.log2(F.greatest(F.col("n") / F.lit(block), F.lit(1.0)))).cast("int")
    return links.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).select(
        "crawl_id", F.pow(F.lit(2.0), powers).cast("bigint").alias("blocks"))


def _waiting(state: DataFrame, ahead: int) -> DataFrame:
    """What each open crawl waits for: (crawl_id, blocks, max_candidates, pages, whole), the last being the ``ahead`` blocks to read whole.

    Those are the blocks of the foremost pages, and if there are fewer the blocks after
    the first of them. The pages are in the order of the queue; the arrays are bounded by the page budget.
    """
    waits = F.sort_array(F.collect_list(F.when(F.col("waits"), F.struct("seq", _block("request_url").alias("b"), "request_url", "blocked"))))
    unblocked = F.filter("w", lambda x: ~x["blocked"])  # a start page may be blocked
    return (
        state.where("open").groupBy("crawl_id")
        .agg(F.first("blocks").alias("blocks"), F.first("max_candidates").alias("max_candidates"), waits.alias("w"))
        .select("crawl_id", "blocks", "max_candidates", F.array_distinct(F.transform(unblocked, lambda x: x["request_url"])).alias("pages"), F.col("w.b").alias("b"))
        .withColumn("next", F.transform(F.sequence(F.lit(0), F.lit(ahead - 1)), lambda k: F.pmod(F.element_at("b", 1) + k, F.col("blocks"))))
        .where(F.size("b") > 0)
        .select("crawl_id", "blocks", "max_candidates", "pages", F.slice(F.array_distinct(F.concat("b", "next")), 1, ahead).alias("whole"))
    )


def _live(waiting: DataFrame, buckets: int) -> list[int]:
    """The buckets that hold what is waited for: at most ``buckets`` numbers."""
    pages = waiting.select(F.explode("pages").alias("page")).select(F.pmod(F.xxhash64("page"), F.lit(buckets)).alias("b"))
    step = F.least(F.col("blocks"), F.lit(buckets)).alias("step")
    whole = waiting.select(step, F.explode("whole").alias("b")).select(
        F.explode(F.sequence(F.pmod(F.col("b"), F.lit(buckets)), F.lit(buckets - 1).cast("bigint"), F.col("step"))).alias("b"))
    return sorted(r[0] for r in pages.unionByName(whole).distinct().collect())


def _with_ready(rows: DataFrame, waiting: DataFrame, page_url: str) -> DataFrame:
    """``rows`` of the crawls in ``waiting`` with ``blocks`` and ``ready``: whether the links of the page are in hand.

    A page is looked up by a join: a crawl may wait for a thousand, and a search through
    them for every link would cost links x pages.
    """
    whose = waiting.select("crawl_id", "blocks", "whole")
    pages = waiting.select("crawl_id", F.explode("pages").alias(page_url), F.lit(True).alias("waited"))
    ready = F.array_contains("whole", _block(page_url)) | F.coalesce("waited", F.lit(False))
    return rows.join(whose, "crawl_id").join(pages, ["crawl_id", page_url], "left").withColumn("ready", ready).drop("whole", "waited")


def _first_targets(links: DataFrame) -> DataFrame:
    """The links of each page that may count: the first to each target, and as many targets as its crawl may have candidates.

    At most that many less those seen are still taken, so of the first ``max_candidates``
    targets enough are new. A start page may lead to all pages of its site. Adds their ``rank`` on the page.
    """
    order = F.struct(F.col("pos").isNull().alias("last"), "pos", "deeper")
    kept = [c for c in ("turn", "max_candidates") if c in links.columns]
    firsts = links.repartition("crawl_id", "src_url").groupBy("crawl_id", "src_url", "url").agg(
        F.min(order).alias("first"), *[F.first(c).alias(c) for c in kept])
    rank = F.row_number().over(W.partitionBy("crawl_id", "src_url").orderBy("first", "url"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= F.col("max_candidates")).select(
        "crawl_id", "src_url", "first.pos", "url", "first.deeper", "rank", *kept)


def _links_in_hand(table: DataFrame, waiting: DataFrame, folder: str) -> DataFrame:
    """The links that a round needs of those of the waited pages and of the whole blocks, from tables below ``folder``.

    The waited pages are visited next and in order. So of all their links the first to each
    target counts, and the first ``max_candidates`` such targets. Where there are that many
    the queue is full after them, and the blocks are not read.
    """
    turns = waiting.select("crawl_id", "max_candidates", F.posexplode("pages").alias("turn", "src_url"))
    on_page = _first_targets(table.join(turns, ["crawl_id", "src_url"]))
    first = on_page.groupBy("crawl_id", "url", "max_candidates").agg(F.min_by(F.struct("src_url", "pos", "deeper", "turn", "rank"), F.struct("turn", "rank")).alias("l"))
    mentions = first.select("crawl_id", "url", "max_candidates", "l.src_url", F.col("l.pos").alias("_pos"), "l.deeper", F.col("l.turn").alias("parent_seq"), F.col("l.rank").alias("pos"))
    links = ["crawl_id", "src_url", "pos", "url", "deeper"]
    waited = written(
        numbered(mentions, F.col("max_candidates")).withColumn("pos", F.col("_pos")).select(*links, "max_candidates"), f"{folder}/waited")
    full = waited.groupBy("crawl_id", "max_candidates").count().where(F.col("count") >= F.col("max_candidates"))
    others = waiting.where(F.size("pages") > 0).join(full.select("crawl_id"), "crawl_id", "left_anti").select("crawl_id", "max_candidates", "blocks", "whole")
    ahead = (
        table.join(others, "crawl_id").where(F.array_contains("whole", _block("src_url")))
        .join(turns.select("crawl_id", "src_url"), ["crawl_id", "src_url"], "left_anti"))
    return waited.select(*links).unionByName(written(_first_targets(ahead).select(*links), f"{folder}/ahead"))


class _Queue:
    """One crawl in a round: its queue so far, and its links in hand. URLs are numbers here."""

    def __init__(self, state: pa.Table, judged: pa.Table, links: pa.Table):
        texts = pa.chunked_array([
            c for t, names in ((state, ("url", "request_url")), (judged, ("url", "request_url")), (links, ("url", "src_url"))) for n in names
            for c in t[n].chunks], pa.string())
        coded = texts.combine_chunks().dictionary_encode()
        self.names = coded.dictionary
        parts = np.split(coded.indices.to_numpy(), np.cumsum([len(state)] * 2 + [len(judged)] * 2 + [len(links)])[:5])
        urls, asked, target, target_asked, link_to, link_from = parts
        n = len(self.names)
        self.request, self.blocked, self.ready = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for url, request, table in ((target, target_asked, judged), (urls, asked, state)):
            self.request[url] = request
            self.blocked[url] = table["blocked"].to_numpy()
            self.ready[request] = table["ready"].to_numpy()
        order = np.lexsort((links["deeper"].to_numpy(), links["pos"].to_numpy(), link_from))
        self.to, self.deeper = link_to[order], links["deeper"].to_numpy()[order]
        self.ends = np.searchsorted(link_from[order], np.arange(n + 1))
        self.too_long = pc.utf8_length(self.names).to_numpy(zero_copy_only=False) > MAX_URL_CHARS
        self.state, self.budget, self.most = state, state["page_budget"][0].as_py(), state["max_candidates"][0].as_py()
        self.queue = urls.tolist()
        self.seen = np.zeros(n, bool)
        self.seen[urls] = True
        self.parent, self.depth, self.wave = [-1] * len(urls), state["depth"].to_pylist(), state["wave"].to_pylist()

    def expand(self, at: int) -> None:
        """Queue the new targets of the page at this place, in the order of its links."""
        page = self.request[self.queue[at]]
        links = slice(self.ends[page], self.ends[page + 1])
        fresh = np.flatnonzero(~self.seen[self.to[links]]) + links.start
        _, first = np.unique(self.to[fresh], return_index=True)
        fresh = fresh[np.sort(first)][: self.most - len(self.queue)]
        found = self.to[fresh]
        self.seen[found] = True
        self.queue += found.tolist()
        self.parent += [int(page)] * len(found)
        self.depth += (self.depth[at] + self.deeper[fresh]).tolist()
        self.wave += [self.wave[at] + 1] * len(found)

    def advance(self) -> pa.Table:
        """Visit the queue while the budget lasts and links are in hand; the rows as they are then."""
        old = len(self.state)
        done = self.state["processed"].to_numpy().tolist()
        at = done.index(False) if False in done else old
        attempts = at - int(self.state["blocked"].to_numpy()[:at].sum())
        aborted, is_open = None, False
        while at < len(self.queue) and attempts < self.budget and aborted is None:
            url = self.queue[at]
            if not self.blocked[url]:
                page = self.request[url]
                if self.too_long[page]:
                    aborted = at
                elif len(self.queue) < self.most:  # a full queue takes no more, whatever the links are
                    if not self.ready[page]:
                        is_open = True
                        break
                    self.expand(at)
                attempts += 1
            at += 1
        n = len(self.queue)
        urls = np.array(self.queue)
        blocked, request = self.blocked[urls], self.request[urls]
        later = np.arange(n) >= at
        upto = np.cumsum(later & ~blocked) <= self.budget - attempts
        waits = later & ~blocked & upto & is_open  # also what is in hand now, as it will not be then
        parents = self.names.take(pa.array([p if p >= 0 else None for p in self.parent], pa.int64()))
        known = self.state["discovered_from"].combine_chunks()
        same = lambda name: pa.array([self.state[name][0].as_py()] * n, _STATE.field(name).type)
        columns = {
            "crawl_id": same("crawl_id"), "url": self.names.take(pa.array(urls)), "request_url": self.names.take(pa.array(request)),
            "discovered_from": pa.concat_arrays([known, parents.slice(old)]), "depth": self.depth, "seq": np.arange(1, n + 1), "wave": self.wave,
            "blocked": blocked, "processed": ~later, "aborts": np.arange(n) == (-1 if aborted is None else aborted),
            "page_budget": same("page_budget"), "max_candidates": same("max_candidates"), "blocks": same("blocks"),
            "open": np.full(n, is_open), "waits": waits,
        }
        return pa.table([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in _STATE], schema=_STATE)


def _round(state: DataFrame, waiting: DataFrame, links: DataFrame, rules: DataFrame, chains: DataFrame) -> DataFrame:
    """The rows of the open crawls after a round: each crawl follows its queue through the links in hand."""
    judged = robots_verdicts(links.select("crawl_id", "url").distinct(), rules, chains).select(
        "crawl_id", "url", request_url("url").alias("request_url"), (~F.col("allowed")).alias("blocked"))
    judged = _with_ready(judged, waiting, "request_url").select("crawl_id", "url", "request_url", "blocked", "ready")
    known = _with_ready(state.where("open").drop("blocks"), waiting, "request_url").select(*_QUEUE, "ready")
    # one table of three kinds of rows, so that a crawl's rows meet in one shuffle
    kinds = known.withColumn("part", F.lit(0)).unionByName(
        judged.withColumn("part", F.lit(1)), allowMissingColumns=True).unionByName(
        links.withColumn("part", F.lit(2)), allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        # the columns that its kind of rows has, before rows are copied
        part, names = table["part"].to_numpy(), ([*_QUEUE, "ready"], ["url", "request_url", "blocked", "ready"], ["src_url", "pos", "url", "deeper"])
        known, judged, links = (table.select(names[k]).filter(pa.array(part == k)) for k in range(3))
        del table, part
        if not len(known):
            return _STATE.empty_table()
        return _Queue(known.sort_by("seq"), judged, links.sort_by("url")).advance()

    return kinds.groupBy("crawl_id").applyInArrow(run, ", ".join(f"{n} {t}" for n, t in _QUEUE.items()))


def expand(
    starts: DataFrame, prefixes: DataFrame, edge_rows: DataFrame, folder: str, buckets: int = 16, block: int = BLOCK, ahead: int = AHEAD
) -> DataFrame:
    """All admitted candidates of all crawls in visiting order.

    ``starts``: crawl_id, start_url and limits of the crawls that may start;
    ``prefixes``: their robots path rules; ``edge_rows``: see ``edges``. Columns of
    the result: crawl_id, url, request_url, discovered_from, depth, seq, wave,
    blocked (by robots), processed (the budget reached it), aborts, ...

    The links are laid out in ``buckets`` (a power of two) folders by the hash of the page they
    start from. A block is what ends in some bits of the same hash, so it lies in
    known buckets. In a round a crawl has in hand the links that count of the pages that
    it waits for, and its queue, both of which the candidate limit bounds, and unless they
    fill the queue ``ahead`` blocks of about ``block`` links each.

    Every round is a table in ``folder``, so a lost executor costs one round's work at
    most. A round reads the rows of the crawls that were open before it, no earlier ones.
    """
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    spark = starts.sparkSession
    rules = written(prefixes, f"{folder}/prefixes")
    chains = written(rule_chains(rules), f"{folder}/rule-chains")
    table = written(
        edge_rows.join(starts.select("crawl_id"), "crawl_id", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("src_url"), F.lit(buckets))),
        f"{folder}/edges", partition_by="bucket")
    seeds = starts.select("crawl_id", F.col("start_url").alias("url"), "max_candidates", page_budget(F.col("max_pages"), F.col("max_requests")).alias("page_budget"))
    first = robots_verdicts(seeds, rules, chains).join(_blocks(table, block), "crawl_id", "left").withColumns({
        "request_url": request_url("url"), "discovered_from": F.lit(None), "depth": F.lit(0), "seq": F.lit(1), "wave": F.lit(0),
        "blocked": ~F.col("allowed"), "processed": F.lit(False), "aborts": F.lit(False), "blocks": F.coalesce("blocks", F.lit(1)),
        "open": F.lit(True), "waits": F.lit(True),
    })
    paths = [f"{folder}/round-0"]
    state = written(first.select(*(F.col(n).cast(t).alias(n) for n, t in _QUEUE.items())), paths[0])
    while True:
        n = len(paths)
        waiting = written(_waiting(state, ahead), f"{folder}/waiting-{n}")
        live = _live(waiting, buckets)
        if not live:
            break
        links = _links_in_hand(table.where(F.col("bucket").isin(live)), waiting, f"{folder}/links-{n}")
        paths.append(f"{folder}/round-{n}")
        state = written(_round(state, waiting, links, rules, chains), paths[-1])
        dropped(spark, f"{folder}/links-{n}", f"{folder}/waiting-{n}")
    return spark.read.schema(state.schema).parquet(*paths).where("NOT open").drop("open", "waits", "blocks")


def crawl_records(frontier: DataFrame, outcomes: DataFrame, pages: DataFrame, gates: DataFrame) -> DataFrame:
    """One record per robots failure, blocked URL and requested URL.

    ``pages`` holds the document columns by (crawl_id, url, capture_id), with texts
    already cut to the policy's limit; they are attached once, as the last step.
    """
    blocked = frontier.where(F.col("processed") & F.col("blocked")).select(
        "crawl_id", "seq", F.lit("blocked_robots").alias("kind"), "url", "discovered_from"
    )
    asked = frontier.where(F.col("processed") & ~F.col("blocked")).select(
        "crawl_id", "seq", F.col("request_url").alias("url"), "discovered_from", "depth", "aborts"
    )
    found = asked.join(outcomes, ["crawl_id", "url"], "left")
    failed = F.coalesce(F.col("kind"), F.lit("download_error")) == "download_error"
    failed = failed | F.col("aborts")
    requested = (
        found.withColumn("failed", failed)
        .withColumns({
            "error_type": F.when(F.col("aborts"), F.lit(BAD_ENCODING)).when(
                F.col("failed"), F.coalesce("error_type", F.lit(NOT_CAPTURED))
            ),
            "phase": F.when(F.col("failed"), F.lit("document")),
            "kind": F.when(F.col("failed"), F.lit("download_error")).otherwise(F.col("kind")),
            "discovered_from": F.when(~F.col("failed"), F.col("discovered_from")),
            "depth": F.when(~F.col("failed"), F.col("depth")),
        })
        .drop("failed", "aborts")
    )
    texts = pages.where(F.col("text").isNotNull()).select("crawl_id", "url", "capture_id", *DOCUMENT)
    of_document = F.when(F.col("kind") == "document", F.col("capture_id"))
    requested = requested.withColumn("capture_id", of_document).join(texts, ["crawl_id", "url", "capture_id"], "left").drop("capture_id")
    robots_url = F.concat("allowed_origin", F.lit("/robots.txt"))
    unavailable = gates.where(F.col("robots_status") == "unavailable").select(
        "crawl_id",
        F.lit(0).cast("bigint").alias("seq"),
        F.when(F.col("robots_error").isNull(), F.lit("robots_error")).otherwise(F.lit("download_error")).alias("kind"),
        robots_url.alias("url"),
        F.col("robots_http_status").alias("http_status"),
        F.col("robots_error").alias("error_type"),
        F.when(F.col("robots_error").isNotNull(), F.lit("robots")).alias("phase"),
    )
    parts: Iterable[DataFrame] = (requested, blocked, unavailable)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reached_documents(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Key and redirect target of every requested page that is a document or an in-scope redirect."""
    reached = frontier.where(F.col("processed") & ~F.col("blocked") & ~F.col("aborts")).select("crawl_id", F.col("request_url").alias("url"))
    return (
        reached.join(outcomes, ["crawl_id", "url"])
        .where((F.col("kind") == "document") | F.col("redirect_to").isNotNull())
        .select("crawl_id", "url", "capture_id", "redirect_to")
    )


def link_exclusions(frontier: DataFrame, links: DataFrame, reached: DataFrame) -> DataFrame:
    """Excluded mentions per crawl and reason: crawl_id, reason, n.

    ``links`` are the decided links of the reached documents. Each of them and
    every in-scope redirect is a mention. A refused one counts under its reason; a
    mention of an admitted URL counts as a duplicate unless it is the one that
    discovered it; any other found no room.
    """
    of_redirects = reached.where(F.col("redirect_to").isNotNull()).select(
        "crawl_id", F.col("redirect_to").alias("url"), F.lit(None).cast("string").alias("reason")
    )
    per_target = (
        links.select("crawl_id", "url", "reason").unionByName(of_redirects)
        .groupBy("crawl_id", "url", "reason").agg(F.count(F.lit(1)).alias("mentions"))
    )
    admitted = frontier.select("crawl_id", "url", (F.col("wave") > 0).cast("bigint").alias("discoveries"))
    known = F.col("discoveries").isNotNull()
    return (
        per_target.join(admitted, ["crawl_id", "url"], "left")
        .withColumn(
            "reason",
            F.coalesce("reason", F.when(known, F.lit("duplicate_url")).otherwise(F.lit("max_candidates"))),
        )
        .withColumn("n", F.col("mentions") - F.coalesce("discoveries", F.lit(0)))
        .groupBy("crawl_id", "reason").agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )
