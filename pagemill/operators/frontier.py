"""Crawl candidates, the frontier in distributed rounds, and the exact best-first order job by job."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import fixed, routes, urls
from pagemill.functions.links import joined
from pagemill.operators.dedup import first_by
from pagemill.shared import bucketed, materialize, once


def candidates(links: DataFrame, roots: DataFrame, follow: bool = False) -> DataFrame:
    """Links (job_id, seq, parent, url, source, anchor_text) with their normalised url and its reason, route and depth-0 score.

    ``roots``: (job_id, root) with the host of each job and, where there are rules, its disallowed prefixes; it is joined,
    not collected. A url is taken apart once a row.
    """
    if "disallowed" not in roots.columns:
        roots = roots.withColumn("disallowed", F.array().cast("array<string>"))
    rows = once(links.join(roots, "job_id"), "norm", joined(F.col("parent"), F.col("url")))
    rows = urls.with_address(urls.with_normalized(rows, "norm", F.col("norm")), "at", "norm")
    at = urls.Address(F.col("norm"), F.col("at"))
    rows = once(rows, "reason", urls.reject_reason(at, F.col("root"), F.lit(follow), F.col("disallowed")))
    rows = once(rows, "route_type", routes.classify_route(at))
    return once(rows, "score", routes.score(at, F.col("source"), F.col("anchor_text"), F.lit(0), F.lit(follow), F.col("route_type"))).drop("at", "disallowed")


def admitted(rows: DataFrame, depth: int) -> DataFrame:
    """First admissible occurrence of each url of a job. The score is judged before the first is taken: an occurrence
    that scores too little does not keep out a later, better one."""
    good = rows.where("reason = 'accepted'").withColumn("score", F.col("score") - 6 * depth).where(f"score >= {fixed.LEAST_SCORE}")
    return first_by(good, ["job_id", "norm"], ["seq"])


def _start(seeds: DataFrame, max_pages: int) -> DataFrame:
    """Seeds (job_id, norm, seq, max_pages); without an order of their own they go by url, without a budget they have the default."""
    seq = F.col("seq").cast("long") if "seq" in seeds.columns else F.lit(-1).cast("long")
    most = F.coalesce(F.col("max_pages").cast("int"), F.lit(max_pages)) if "max_pages" in seeds.columns else F.lit(max_pages)
    return seeds.select("job_id", "norm", seq.alias("seq"), most.alias("max_pages")).groupBy("job_id", "norm").agg(F.min("seq").alias("seq"), F.max("max_pages").alias("max_pages"))


def crawl_rounds(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, max_pages: int = 300) -> DataFrame:
    """(job_id, norm, depth, score, seq, status) of the urls a crawl in rounds comes upon.

    ``edges``: the links as ``candidates`` gives them, with ``parent_norm``; ``seeds``: (job_id, norm), with seq (their
    order, below 0) and max_pages (the job's own budget) if there are any. In each round the best pending urls of each job, within what is left of its budget, are crawled and their links admitted. Depth by
    depth, so the order differs from a best-first crawl; each round is written out, and the driver sees only whether
    there is another.
    """
    start = materialize(_start(seeds, max_pages), "seeds")
    # the links of a page are looked up in every round, and stay where they are
    edges = bucketed(edges.where("reason = 'accepted'").select("job_id", "parent_norm", "norm", "reason", "score", "seq"), ["job_id", "parent_norm"], "edges")
    budgets = start.groupBy("job_id").agg(F.max("max_pages").alias("budget"))
    largest = start.agg(F.max("max_pages")).first()[0] or 0
    # what was found and what was crawled only grow: each round writes its own rows
    found = start.select("job_id", "norm", F.lit(0).alias("depth"), F.lit(100).alias("score"), "seq")
    crawled = None
    best = Window.partitionBy("job_id").orderBy(F.desc("score"), "seq", "norm")
    for depth in range(1, max_depth + 2):
        waiting = found if crawled is None else found.join(crawled, ["job_id", "norm"], "left_anti")
        # the bound on the rank alone lets each task keep a job's best rows only, before they are brought together
        ranked = waiting.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= largest).join(budgets, "job_id")
        if crawled is None:
            ranked = ranked.where(F.col("rank") <= F.col("budget"))
        else:
            used = crawled.groupBy("job_id").agg(F.count("*").alias("used"))
            ranked = ranked.join(used, "job_id", "left").where(F.col("rank") + F.coalesce("used", F.lit(0)) <= F.col("budget"))
        now = materialize(ranked.select("job_id", "norm"), "crawled")
        crawled = now if crawled is None else crawled.union(now)
        if depth > max_depth or now.isEmpty():
            break
        out = edges.join(now.withColumnRenamed("norm", "parent_norm"), ["job_id", "parent_norm"], "left_semi")
        new = admitted(out.join(found.select("job_id", "norm"), ["job_id", "norm"], "left_anti"), depth)
        new = materialize(new.select("job_id", "norm", F.lit(depth).alias("depth"), "score", "seq"), "found")
        found = found.union(new)
    status = F.when(F.col("done"), "completed").otherwise("pending").alias("status")
    return found.join(crawled.withColumn("done", F.lit(True)), ["job_id", "norm"], "left").select("job_id", "norm", "depth", "score", "seq", status)


def _best_first(max_depth: int):
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {}
        by_parent: dict[str, list] = {}
        edges = edges.sort_values(["seq", "seed"])
        max_pages = edges["max_pages"].max()
        for row in edges.itertuples(index=False):
            by_parent.setdefault(row.parent_norm, []).append(row)
        heap: list[tuple[int, int, str]] = []

        def enqueue(norm, score, depth):
            out[norm] = [depth, score, None]
            heapq.heappush(heap, (-score, len(out), norm))

        for seed in edges["seed"].dropna().unique():
            enqueue(seed, 100, 0)
        done = 0
        while heap and done < max_pages:
            _, _, norm = heapq.heappop(heap)
            out[norm][2], done = done, done + 1
            depth = out[norm][0] + 1
            for link in by_parent.get(norm, ()):
                score = link.score - 6 * depth
                if link.norm not in out and depth <= max_depth and score >= fixed.LEAST_SCORE:
                    enqueue(link.norm, score, depth)
        job = edges["job_id"].iloc[0]
        return pd.DataFrame([(job, n, d, s, -1 if v is None else v) for n, (d, s, v) in out.items()], columns=["job_id", "norm", "depth", "score", "visit"])

    return run


def crawl_exact(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, max_pages: int = 300) -> DataFrame:
    """(job_id, norm, depth, score, visit): the order of a crawl with one worker, best score first, then first come.

    ``seeds`` as in ``crawl_rounds``. A job is one task's work, as its order is sequential; its pages are bounded by its budget, and links that cannot
    be admitted at any depth, and all but the best-placed occurrences of a link on its page, are left out before.
    """
    useful = edges.where("reason = 'accepted'").where(f"score - 6 >= {fixed.LEAST_SCORE}").select("job_id", "parent_norm", "norm", "score", "seq")
    once = useful.groupBy("job_id", "parent_norm", "norm", "score").agg(F.min("seq").alias("seq"))
    # every job has a row even without links
    start = _start(seeds, max_pages).select("job_id", F.lit(None).cast("string").alias("parent_norm"), F.lit(None).cast("string").alias("norm"), F.lit(0).alias("score"), "seq", F.col("norm").alias("seed"), "max_pages")
    rows = once.select("*", F.lit(None).cast("string").alias("seed"), F.lit(0).alias("max_pages")).unionByName(start)
    return rows.groupBy("job_id").applyInPandas(_best_first(max_depth), "job_id string, norm string, depth int, score int, visit int")
