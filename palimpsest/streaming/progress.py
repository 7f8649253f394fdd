"""Progress of a comparison as a plain generator: stages are Spark actions, events are what is known after each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.tree import build_nodes, leaves
from palimpsest.params import Params
from palimpsest.plans import align, provenance, report, summarize
from palimpsest.plans.staging import staged


@dataclass(frozen=True)
class Event:
    stage: str
    percent: int
    message: str
    result: dict[str, DataFrame] = field(default_factory=dict)
    summary: str = ""


def compare_stream(blocks: DataFrame, pages: DataFrame, params: Params = Params(), out_dir: str | None = None, callback: Callable[[Event], None] | None = None) -> Iterator[Event]:
    """Compare all document pairs in ``blocks``; the last event carries nodes, vectors, changes, packs,
    summaries, counts. With ``out_dir`` the vectors are written as ``embeddings`` there, in folders by side."""

    def tell(*args, **kw) -> Event:
        event = Event(*args, **kw)
        if callback:
            callback(event)
        return event

    yield tell("starting", 1, "Starting")
    yield tell("parsing", 8, "Building trees")
    nodes = staged(build_nodes(blocks, pages, params.max_tokens_per_node), "nodes")
    yield tell("embedding", 25, "Making vectors of leaves")
    vectors = staged(align.leaf_vectors(leaves(nodes), params), "vectors")
    if out_dir:
        vectors.write.mode("overwrite").partitionBy("doc_side").parquet(f"{out_dir}/embeddings")
    yield tell("matching", 55, "Aligning sections and paragraphs")
    changes = staged(align.align(nodes, params, vectors), "changes")
    yield tell("summarizing", 72, "Summarizing changes")
    packs = staged(provenance.context_packs(changes, nodes, params.neighbors_window), "packs")
    summaries = staged(summarize.summarize(packs, params.summarizer), "summaries")
    yield tell("reporting", 95, "Writing reports")
    if out_dir:
        report.write_reports(changes, out_dir, summaries, nodes)
    yield tell("done", 100, "Done", result={"nodes": nodes, "vectors": vectors, "changes": changes, "packs": packs, "summaries": summaries, "counts": align.count_changes(changes)})


def summary_stream(result: dict[str, DataFrame], pair_id: str) -> Iterator[Event]:
    """One event per growing prefix of each summary of a pair that isn't unchanged, in the order of its changes.

    ``result`` is that of compare_stream(). Rows reach the driver partition by partition, so a long change set isn't held there."""
    changes = result["changes"].where(F.col("pair_id") == pair_id)
    total = changes.count()
    name = F.coalesce("legacy_id", "modern_id")
    rows = changes.where("change_type <> 'unchanged'").select("match_seq", "change_type", name.alias("node_id"))
    rows = rows.join(result["summaries"].where(F.col("pair_id") == pair_id).select("match_seq", "summary"), "match_seq")
    for r in rows.withColumn("prefixes", T.text_prefixes(F.coalesce("summary", F.lit("")))).orderBy("match_seq").toLocalIterator():
        for text in r["prefixes"]:
            said = f"- **{r['change_type'].title()}** `{r['node_id']}`: {text}".strip()
            yield Event("llm", min(92, 72 + 18 * r["match_seq"] // total), f"Summarizing change {r['match_seq']}/{total}", {}, said)
