"""Robots rules as tables: line groups by windows, paths sorted in between the rules."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagetab.functions.reuse import reusable
from pagetab.functions.text import WHITE_SPACE
from pagetab.functions.urls import percent_decode
from pagetab.operators.classify import BAD_ENCODING, NOT_CAPTURED, has_residual, is_plain_text, stated_type

USER_AGENT = "pagetab/0.1"

# Fixed value: a longer requested delay stops the crawl.
MAX_ROBOTS_DELAY = 60

_MEMBERS = ("disallow", "allow", "crawl-delay", "request-rate")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}|{WHITE_SPACE}\z", "")


def robots_gate(crawls: DataFrame, robots: DataFrame) -> DataFrame:
    """Decide per crawl whether its robots file lets it start.

    ``crawls`` needs crawl_id, allowed_origin and max_body_bytes. Adds robots_status
    (loaded, missing_404, unavailable), robots_http_status, robots_error and the
    body of a loaded file.
    """
    answer = robots.select(
        "crawl_id",
        F.col("http_status").alias("robots_http_status"),
        F.col("content_type").alias("robots_type"),
        F.col("content_encoding").alias("robots_encoding"),
        F.col("body").alias("robots_body"),
        F.col("error_type").alias("robots_failure"),
        F.lit(True).alias("robots_captured"),
    )
    error = (
        F.when(F.col("robots_captured").isNull(), F.lit(NOT_CAPTURED))
        .when(F.col("robots_failure").isNotNull(), F.col("robots_failure"))
        .when(F.octet_length("robots_body") > F.col("max_body_bytes"), F.lit("DownloadCancelledError"))
        .when(has_residual(F.col("robots_encoding")), F.lit(BAD_ENCODING))
    )
    kind = stated_type(F.col("robots_type"), F.lit("http://host/robots.txt"))
    status = (
        F.when(F.col("robots_error").isNotNull(), F.lit("unavailable"))
        .when(F.col("robots_http_status") == 404, F.lit("missing_404"))
        .when(F.col("robots_http_status").between(200, 299) & is_plain_text(kind), F.lit("loaded"))
        .otherwise(F.lit("unavailable"))
    )
    return (
        crawls.join(answer, "crawl_id", "left")
        .withColumn("robots_error", error)
        .withColumn("robots_status", status)
        .withColumn("robots_http_status", F.when(F.col("robots_error").isNull(), F.col("robots_http_status")))
        .withColumn("robots_body", F.when(F.col("robots_status") == "loaded", F.col("robots_body")))
        .drop("robots_type", "robots_encoding", "robots_failure", "robots_captured")
    )


def robots_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per line that matters: crawl_id, seq, event (agent, rule, blank), directive, value."""
    lines = bodies.select("crawl_id", F.posexplode(F.split(F.col(body), r"\R|[\x1c-\x1e]")).alias("seq", "line"))
    content = _strip(F.substring_index("line", "#", 1))
    cut = F.instr("content", ":")
    directive = F.lower(_strip(F.substring_index("content", ":", 1)))
    value = percent_decode(_strip(F.expr("substring(content, instr(content, ':') + 1)")))
    return (
        lines.withColumn("content", content)
        .withColumn("directive", F.when(cut > 0, directive))
        .withColumn("value", F.when(cut > 0, value))
        .withColumn(
            "event",
            F.when(F.col("line") == "", F.lit("blank"))
            .when(F.col("directive") == "user-agent", F.lit("agent"))
            .when(F.col("directive").isin(*_MEMBERS), F.lit("rule")),
        )
        .where(F.col("event").isNotNull())
        .select("crawl_id", "seq", "event", "directive", "value")
    )


def robots_groups(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Agent and rule lines with their group: crawl_id, grp, seq, event, directive, value.

    Consecutive agent lines share a group, an empty line ends it, rules outside
    a group do not count. The windows run over the lines of one robots file, whose
    size the body limit bounds.
    """
    by_line = W.partitionBy("crawl_id").orderBy("seq")
    so_far = by_line.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        robots_lines(bodies, body)
        .withColumn("before", F.lag("event").over(by_line))
        .withColumn("opens", (F.col("event") == "agent") & F.coalesce(F.col("before") != "agent", F.lit(True)))
        .withColumn("grp", F.sum(F.col("opens").cast("int")).over(so_far))
        .withColumn(
            "owner", F.last(F.when(F.col("event") != "rule", F.col("event")), ignorenulls=True).over(so_far)
        )
        .where((F.col("event") == "agent") | ((F.col("event") == "rule") & (F.col("owner") == "agent")))
        .select("crawl_id", "grp", "seq", "event", "directive", "value")
    )


def robots_rules(groups: DataFrame) -> DataFrame:
    """Rule lines of ``robots_groups``: crawl_id, grp, seq, directive, value."""
    return groups.where(F.col("event") == "rule").select("crawl_id", "grp", "seq", "directive", "value")


def named_rules(groups: DataFrame) -> DataFrame:
    """``robots_rules`` with the names of each rule's group in one column, for display."""
    names = (
        groups.where(F.col("event") == "agent").groupBy("crawl_id", "grp")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("agents"))
    )
    return robots_rules(groups).join(names, ["crawl_id", "grp"]).select("crawl_id", "grp", "seq", "agents", "directive", "value")


def effective_rules(groups: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """The rules of the one group per crawl that applies to ``user_agent``.

    The first named group one of whose names occurs in the agent token, else the
    first group for every agent. Names are judged line by line and the group is
    chosen by an aggregation, so that agents never meet rules but by their group.
    """
    token = user_agent.split("/")[0].lower()
    name = F.col("value")
    per_group = groups.groupBy("crawl_id", "grp").agg(
        F.bool_or((F.col("event") == "agent") & (name == "*")).alias("for_all"),
        F.bool_or((F.col("event") == "agent") & (F.instr(F.lit(token), F.lower(name)) > 0)).alias("named"),
        F.bool_or(F.col("event") == "rule").alias("has_rule"),
    )
    rank = F.when(~F.col("for_all") & F.col("named"), F.struct(F.lit(0), F.col("grp"))).when(
        F.col("for_all"), F.struct(F.lit(1), F.col("grp")))
    chosen = (
        per_group.where("has_rule").withColumn("rank", rank).where(F.col("rank").isNotNull())
        .groupBy("crawl_id").agg(F.min_by("grp", "rank").alias("grp"))
    )
    return robots_rules(groups).join(chosen, ["crawl_id", "grp"])


def crawl_delays(effective: DataFrame) -> DataFrame:
    """robots_delay per crawl: the last all-digit Crawl-delay of the group that applies."""
    stated = (F.col("directive") == "crawl-delay") & F.col("value").rlike(r"\A[0-9]+\z")
    # A number too long for a bigint is beyond any limit as well.
    number = F.coalesce(F.col("value").try_cast("bigint"), F.lit(2**63 - 1))
    return effective.where(stated).groupBy("crawl_id").agg(F.max_by(number, "seq").alias("robots_delay"))


def delay_gate(delay: Column, robots_delay: Column) -> Column:
    """Effective delay between requests, null when the robots file asks for too long a one."""
    asked = F.coalesce(robots_delay.cast("double"), F.lit(0.0))
    return F.when(asked <= MAX_ROBOTS_DELAY, F.greatest(delay, asked))


def _tidy_path(text: Column) -> Column:
    """Drop an empty fragment, query or parameter part."""
    no_fragment = F.regexp_replace(text, r"\A([^#]*)#\z", "$1")
    no_query = F.regexp_replace(no_fragment, r"(?s)\A([^?#]*)\?(#.*)?\z", "$1$2")
    return F.regexp_replace(no_query, r"(?s)\A((?:[^?#]*/)?[^/?#;]*);([?#].*)?\z", "$1$2")


@reusable
def robots_path(url: Column) -> Column:
    """The part of a URL that rules are compared with: decoded once, from the path on."""
    tail = F.regexp_replace(percent_decode(url), r"(?s)\Ahttps?://[^/?#]*", "")
    tidy = _tidy_path(tail)
    return F.when(tidy == "", F.lit("/")).when(tidy.startswith("//"), F.concat(F.lit("//"), tidy)).otherwise(tidy)


def path_rules(effective: DataFrame) -> DataFrame:
    """Path prefixes per crawl: crawl_id, prefix, seq, allow; of equal prefixes the first one counts."""
    rules = effective.where(F.col("directive").isin("allow", "disallow")).select(
        "crawl_id",
        _tidy_path(F.col("value")).alias("prefix"),
        "seq",
        ((F.col("directive") == "allow") | (F.col("value") == "")).alias("allow"),
    )
    return (
        rules.groupBy("crawl_id", "prefix")
        .agg(F.min("seq").alias("seq"), F.min_by("allow", "seq").alias("allow"))
    )


#: URLs of one crawl that are sorted together with its rules, about.
SORTED = 100_000


def rule_chains(prefixes: DataFrame) -> DataFrame:
    """(crawl_id, prefix, chain): the verdicts that a path beginning with ``prefix``, or with a part of it, can get.

    ``chain`` lists (length, allow) from the shortest rule that ``prefix`` begins with to ``prefix``
    itself: by the first in file order of the rules up to that length, listed where it changes. The rules of a
    crawl are one group; the body limit of the robots file bounds them.
    """

    def run(table: pa.Table) -> pa.Table:
        rules = sorted(zip(table["prefix"].to_pylist(), table["seq"].to_pylist(), table["allow"].to_pylist(), strict=True))
        open_rules: list[tuple[str, float, tuple]] = [("", math.inf, ())]
        lengths, allows, offsets = [], [], [0]
        for prefix, seq, allow in rules:
            while not prefix.startswith(open_rules[-1][0]):
                open_rules.pop()
            _, first, chain = open_rules[-1]
            if seq < first:
                first = seq
                if not chain or chain[-1][1] != allow:
                    chain = (*chain, (len(prefix), allow))
            open_rules.append((prefix, first, chain))
            lengths.extend(n for n, _ in chain)
            allows.extend(a for _, a in chain)
            offsets.append(len(lengths))
        entries = pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.array(allows, pa.bool_())], ["n", "allow"])
        chains = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        return pa.table({"crawl_id": table["crawl_id"], "prefix": pa.array([r[0] for r in rules], pa.string()), "chain": chains})

    return prefixes.groupBy("crawl_id").applyInArrow(run, "crawl_id string, prefix string, chain array<struct<n:int,allow:boolean>>")


def robots_verdicts(urls: DataFrame, prefixes: DataFrame, chains: DataFrame | None = None, together: int = SORTED) -> DataFrame:
    """Add ``allowed`` to rows of (crawl_id, url, ...): the first matching rule in file order decides.

    A rule matches a prefix of the path. All rules that match a path are prefixes
    of the last rule that does not sort after it, so paths are sorted in between the
    rules of their crawl and take that one's chain (see ``rule_chains``, which
    ``chains`` may give as a table): a row for each URL, however many lengths the
    rules have. A crawl of many URLs is sorted in parts of about ``together``, each with
    a copy of its rules. Every distinct URL is judged once; rows that repeat keep their number.
    """
    chains = rule_chains(prefixes) if chains is None else chains
    asked = urls.select("crawl_id", "url").distinct().join(chains.select("crawl_id").distinct(), "crawl_id", "left_semi")
    parts = asked.groupBy("crawl_id").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("url"), F.col("_parts")).cast("int").alias("_part")
    paths = asked.join(parts, "crawl_id").select("crawl_id", part, robots_path("url").alias("_text"), F.lit(1).alias("_kind"), "url")
    rules = chains.join(parts, "crawl_id").select(
        "crawl_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("prefix").alias("_text"), F.lit(0).alias("_kind"), "chain")
    before = W.partitionBy("crawl_id", "_part").orderBy("_text", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rule = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("_text").alias("prefix"), "chain")), ignorenulls=True).over(before)
    both = paths.unionByName(rules, allowMissingColumns=True).withColumn("_rule", rule).where(F.col("_kind") == 1)
    # the entries that match come first: their number by halving, up to the lengths that a file of 100 MB can nest
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(14))))

    def further(n: Column, step: Column) -> Column:
        length = F.get("_rule.chain", n + step - 1)["n"]
        return F.when(F.col("_text").startswith(F.substring(F.col("_rule.prefix"), F.lit(1), length)), n + step).otherwise(n)

    met = F.aggregate(steps, F.lit(0), further)
    judged = both.withColumn("_met", met).select("crawl_id", "url", F.get("_rule.chain", F.col("_met") - 1)["allow"].alias("_allow"))
    return urls.join(judged, ["crawl_id", "url"], "left").select(*urls.columns, F.coalesce("_allow", F.lit(True)).alias("allowed"))
