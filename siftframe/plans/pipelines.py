"""Pipelines that callers run: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import joins as J
from ..operators import limits as L
from ..operators import projections as P
from ..operators import sets as U
from ..operators import windows as W
from ..operators.crawl import crawl_frontier
from ..operators.extract import BLOCK_ENGINES, extract_links, extract_results, extract_serp_features
from ..sources.folders import written
from ..sources.readers import read_embedded_extras
from ..sources.sinks import envelopes, organic


def captured_results(captured: DataFrame, rules=None, fn=None) -> DataFrame:
    """Result rows (query_id, engine, page, pos, title, url, snippet) of captured pages (page_id, query_id, engine, page,
    html): the layout of each page's engine, or fn (see extract_results). Block pages give none. The pages are read once,
    in one pass without a shuffle, and the rows are written, since every path reads them several times."""
    label = FI.classify_pages(captured.withColumn("url", F.lit(None).cast("string")))
    good = label.where("label = 'ok'").select("page_id", "query_id", "engine", "page", "html")
    rows = extract_results(good, rules, fn, keep=("query_id", "page"))
    return written(rows.select("query_id", "engine", "page", F.col("rank").alias("pos"), "title", "url", "snippet"), "results")


def host_options(results: DataFrame, options: dict | None, by=("query_id", "engine")) -> DataFrame:
    """results as a host search shows them: options are min_ports, has_vulns, sort (ports, vulns or ip) and fields. Rows
    that have no host yet get one from their url and title; sort gives pos anew; without options nothing changes."""
    if not options:
        return results
    rows = results
    if "host" not in rows.columns:
        gone = {"ip": "string", "ports": "array<int>", "hostnames": "array<string>", "org": "string"}
        rows = P.to_host_records(rows.withColumns({c: F.lit(None).cast(t) for c, t in gone.items() if c not in rows.columns}))
        rows = rows.select(*results.columns, "host")
    rows = FI.filter_hosts(rows, min_ports=options.get("min_ports"), has_vulns=bool(options.get("has_vulns")))
    if options.get("sort"):
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*L.host_order(options["sort"]), "page", "pos"))
        rows = rows.withColumn("pos", at).withColumn("page", F.lit(1))
    return P.project_host_fields(rows, options["fields"]) if options.get("fields") else rows


def _shaped(results: DataFrame, queries: DataFrame, hosts: dict | None = None) -> DataFrame:
    """The filters of the search paths: host options, what each query's policy leaves out, what its operators enforce."""
    rows = host_options(results, hosts).join(queries.select("query_id", "policy"), "query_id", "left")
    return FI.enforce_operators(FI.filter_domains(rows, policy_col="policy").drop("policy"), queries)


def plan_queries(queries: DataFrame) -> DataFrame:
    """(query_id, q, engines, params) with engine_list, try_list, operators and policy. A query whose parameter fallback
    or auto_fallback is 0 or false tries only the engines it names."""
    rows = P.resolve_filter_policy(P.parse_query_operators(P.normalize_queries(queries)))
    off = [F.coalesce(F.try_element_at("params", F.lit(k)).isin("0", "false"), F.lit(False)) for k in ("fallback", "auto_fallback")]
    rows = U.fallback_order(P.alias_engines(rows).withColumn("_off", off[0] | off[1]), off="_off")
    return rows.drop("_off")


EXTRAS = ("knowledge_graph", "answer_box", "people_also_ask", "related_searches")


def page_extras(captured: DataFrame) -> DataFrame:
    """(query_id, engine, knowledge_graph, answer_box, people_also_ask, related_searches) of captured pages of block
    layouts: each from the first page of a query and engine that has it, as the page shows it, or else as a comment in
    it says. Pages without a query or engine, and null pages, have none. Only these engines' pages reach Python."""
    pages = captured.where(F.col("engine").isin(*BLOCK_ENGINES) & F.col("html").isNotNull())
    shown = extract_serp_features(pages.select(F.struct("query_id", "engine", "page", "page_id").alias("page_id"), "html"))
    said = read_embedded_extras(pages).select(F.struct("query_id", "engine", "page", "page_id").alias("at"), "extras")
    graph = F.col("extras.knowledgeGraph")
    fields = {"title": "title", "type": "type", "description": "description", "imageUrl": "image_url", "attributes": "attributes"}
    renamed = F.struct(*[graph[old].alias(new) for old, new in fields.items()])
    said = said.where("extras is not null").select(
        "at", F.lit(1).alias("_k"), F.when(graph.isNotNull(), renamed).alias("knowledge_graph"), F.col("extras.answerBox").alias("answer_box"),
        F.transform("extras.peopleAlsoAsk", lambda x: x["question"]).alias("people_also_ask"), F.transform("extras.relatedSearches", lambda x: x["query"]).alias("related_searches"),
    )
    shown = shown.select(F.col("page_id").alias("at"), F.lit(0).alias("_k"), *EXTRAS)
    both = shown.unionByName(said)
    first = lambda c, there: F.min_by(F.col(c), F.when(there, F.struct("at.page", "at.page_id", "_k"))).alias(c)
    there = {c: F.col(c).isNotNull() & (F.size(c) > 0 if c in EXTRAS[2:] else F.lit(True)) for c in EXTRAS}
    return both.groupBy("at.query_id", "at.engine").agg(*[first(c, there[c]) for c in EXTRAS])


def search_fallback(
    captured: DataFrame, queries: DataFrame, num: int = 10, *,
    hosts: dict | None = None, extras: bool = False, suggestions: DataFrame | None = None, news: DataFrame | None = None,
) -> DataFrame:
    """One envelope a query: results of the first engine, in the order tried, that still has any after all filters, one a
    canonical url, ranked. captured are result pages (page_id, query_id, engine, page, html) and perhaps duration_ms;
    queries comes from plan_queries; hosts are the host options.

    With extras, an envelope also has what the pages of its engine show beside the results (see page_extras): knowledge
    graph, answer box, questions and related searches. suggestions (query_id, suggestions) and news (query_id, news) are
    attached to envelopes of block engines, ten at most; lists that are empty are null."""
    tried = queries.select("query_id", F.posexplode("try_list").alias("engine_pos", "engine"))
    rows = captured_results(captured).join(tried, ["query_id", "engine"])
    kept = W.dedupe_canonical(_shaped(rows, queries, hosts), num, ("query_id", "engine"))
    won, asked = U.first_nonempty_engine(kept, tried)
    ranked = W.with_ranks(W.top(won, num))
    last = asked.groupBy("query_id").agg(F.max_by("engine", "engine_pos").alias("engine"), F.max_by("code", "engine_pos").alias("code"), F.max("ok").alias("ok"))
    out = envelopes(ranked, last.join(_durations(captured), ["query_id", "engine"], "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0.0))))
    if extras:
        out = out.join(page_extras(captured), ["query_id", "engine"], "left").select(*out.columns, *[F.when(F.col("success"), F.col(c)).alias(c) for c in EXTRAS])
    none = lambda name: queries.select("query_id", F.lit(None).cast("array<string>").alias(name)).limit(0)
    if suggestions is not None or news is not None:
        names = [c for side in (suggestions, news) if side is not None for c in side.columns if c != "query_id"]
        full = J.attach_enrichment(out, suggestions if suggestions is not None else none("suggestions"), news if news is not None else none("news"))
        mine = F.col("success") & F.col("engine").isin(*BLOCK_ENGINES)
        out = full.select(*out.columns, *[F.when(mine, F.col(c)).alias(c) for c in names])
    return out


def _durations(captured: DataFrame) -> DataFrame:
    """How long the pages of a query and engine took, one after the other."""
    ms = F.col("duration_ms") if "duration_ms" in captured.columns else F.lit(0.0)
    return captured.groupBy("query_id", "engine").agg(F.sum(ms.cast("double")).alias("duration_ms"))


def search_merge(captured: DataFrame, queries: DataFrame, num: int = 10, *, canonical: bool = True, hosts: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, ranked results of all engines a query asks for, num at most; summary: engines tried and with results,
    count, longest duration, sources). captured and hosts as in search_fallback; a column source is `lite` if absent."""
    asked = queries.select("query_id", F.posexplode("engine_list").alias("engine_pos", "engine"))
    rows = _shaped(captured_results(captured).join(asked, ["query_id", "engine"]), queries, hosts)
    merged = U.merge_engines(rows, num, canonical=canonical)
    source = (F.first("source") if "source" in captured.columns else F.lit("lite")).alias("source")
    took = _durations(captured).join(captured.groupBy("query_id", "engine").agg(source), ["query_id", "engine"])
    some = rows.select("query_id", "engine").distinct().withColumn("ok", F.lit(True))
    outcomes = asked.join(took, ["query_id", "engine"]).join(some, ["query_id", "engine"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return merged, A.merge_summary(merged, outcomes)


def search_compact(captured: DataFrame, queries: DataFrame, params: list[str]) -> DataFrame:
    """Compact envelopes of captured pages, of the first engine that has results; operators are enforced, and urls
    deduped by their canonical form, only for queries that have operators."""
    tried = queries.select("query_id", F.posexplode("try_list").alias("engine_pos", "engine"))
    rows = captured_results(captured).join(tried, ["query_id", "engine"])
    shaped = _shaped(rows, queries)
    marked = queries.where("has_operators").select("query_id")
    some = W.dedupe_canonical(shaped.join(marked, "query_id", "left_semi"), None, ("query_id", "engine"))
    rest = shaped.join(marked, "query_id", "left_anti")
    return organic(U.engine_of_first(some.unionByName(rest)), queries.select("query_id", *params))


ANSWER = "array<struct<rank:int,title:string,url:string,snippet:string>>"


def batch_search(captured: DataFrame, queries: DataFrame, stored: DataFrame, ttl_s: int = 300, *, num: int = L.MOST) -> tuple[DataFrame, DataFrame]:
    """(answers, summary) of a query list (query_id, batch_id, position, key, ts), as read_queries gives it with numbers,
    keys and times. An answer has engine, count and results (rank, title, url, snippet), one a url, num at most.

    Stored answers that are young enough are taken with the engine, count and results that they were stored with
    (columns of `stored`; null where it has none); storable gives the form. The others get the results of their first
    engine that has any, from captured pages. No filters run on this path; an answer from the store takes no time."""
    have = [c for c in ("engine", "count", "results") if c in stored.columns]
    kept = stored.select("key", "stored_ts", *[F.col(c).alias(f"_{c}") for c in have])
    hits, misses = J.split_cached(queries.select("query_id", "batch_id", "position", "key", "ts"), kept, ttl_s)
    rows = captured_results(captured.join(misses.select("query_id"), "query_id", "left_semi"))
    order = captured.select("query_id", "engine", "engine_pos").distinct()
    fresh = U.engine_of_first(rows.join(order, ["query_id", "engine"]))
    fresh = W.with_ranks(W.top(W.first_wins(fresh), min(L.MOST, max(1, num))))
    lists = fresh.groupBy("query_id", "engine").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", "snippet"))).cast(ANSWER).alias("results"))
    cols = ["query_id", "batch_id", "position", "ts"]
    none = F.array().cast(ANSWER)
    a = misses.join(lists.join(_durations(captured), ["query_id", "engine"]), "query_id", "left")
    a = a.withColumns({"results": F.coalesce("results", none), "duration_ms": F.coalesce("duration_ms", F.lit(0.0)), "cached": F.lit(False)})
    a = a.select(*cols, "engine", F.size("results").cast("long").alias("count"), "cached", "duration_ms", "results")
    old = lambda c, kind: (F.col(f"_{c}") if c in have else F.lit(None)).cast(kind).alias(c)
    b = hits.withColumns({"cached": F.lit(True), "duration_ms": F.lit(0.0)})
    b = b.select(*cols, old("engine", "string"), old("count", "long"), "cached", "duration_ms", old("results", ANSWER))
    answers = a.unionByName(b).withColumn("ok", F.col("cached") | (F.col("count") > 0))
    return answers, A.batch_summary(answers)


def storable(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, stored_ts, engine, count, results): what a later batch may take from these answers: successful ones with
    results that were not taken from the store themselves, as of their query's time."""
    good = answers.where((~F.col("cached")) & (F.col("count") > 0))
    return good.join(queries.select("query_id", "key"), "query_id").select("key", F.col("ts").alias("stored_ts"), "engine", "count", "results")


def crawl(pages: DataFrame, starts: DataFrame, max_pages: int = 8, max_depth: int = 1, *, same_origin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(visited pages, summary) of bounded traversals over captured pages; links to private hosts are not followed."""
    links = FI.guard_links(extract_links(pages), origin="src_url" if same_origin else None)
    return crawl_links(links, starts, max_pages, max_depth)


def crawl_links(links: DataFrame, starts: DataFrame | None = None, max_pages: int = 8, max_depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """As crawl, over a link table; without starts, every page that has links is one."""
    reach = written(crawl_frontier(links, starts, max_pages + 1, max_depth, cap_pages=max_pages + 1), "crawl")
    visited = reach.where(F.col("visit_order") <= max_pages)
    return visited, A.crawl_summary(visited, reach, max_pages)


def host_inventory(lookups: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, summary) of a list of addresses (ip): labelled, shaped as host records and enriched from the scan."""
    rows = FI.label_ip_rows(lookups, scan)
    none = {"ports": "array<int>", "hostnames": "array<string>", "org": "string"}
    named = {"url": F.concat(F.lit("http://"), "ip"), "title": F.col("ip")}
    shaped = rows.withColumns(named | {c: F.lit(None).cast(kind) for c, kind in none.items()})
    shaped = P.to_host_records(shaped).withColumn("host", F.when(F.coalesce(F.col("code"), F.lit("")) != "INVALID_IP", F.col("host")))
    return J.enrich_hosts(shaped.drop("url", "title", "ports", "hostnames", "org"), scan), A.host_lookup_summary(rows)


def health_report(outcomes: DataFrame, registry: DataFrame, now: Column | None = None) -> DataFrame:
    """Every registered engine with its breaker counters, the state of its breaker at a time (the newest outcome's, if
    none is given), its outcome counts, and the latency figures of all."""
    log = outcomes.join(F.broadcast(outcomes.agg(F.max("ts").alias("_newest"))), F.lit(True))
    state = A.breaker_state(log, F.col("_newest") if now is None else now)
    status = J.engine_status(registry, A.breaker_counters(outcomes), state)
    counts = A.outcomes_by_key(outcomes).select(F.col("key").alias("engine"), "fail", "lite", "render")
    rows = status.join(counts, "engine", "left").fillna(0, ["fail", "lite", "render"])
    return rows.join(F.broadcast(A.latency_percentiles(outcomes)), F.lit(True))
