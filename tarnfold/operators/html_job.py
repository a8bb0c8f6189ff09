"""The structural HTML pass: pages or note bodies to Markdown, one mapInArrow job. A bad page degrades; it never fails the job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.html_walk import MarkdownWriter
from tarnfold.functions.slices import slices
from tarnfold.operators.html_body import body_of


def to_markdown(html: str | None, resources: dict[str, str] | None = None) -> dict:
    """markdown, quality (full or degraded), degradation codes joined by commas, the counters, and by line remote images, links to notes, links elsewhere, and hint|cipher|length of encrypted blocks.

    What Markdown can't hold is never full: spans, blocks and tables in table cells, structure that is too deep, elements that were never
    closed and took text along (unsupported-structure), images with an unsafe address (asset-incomplete), embedded content.
    """
    writer = MarkdownWriter(resources)
    codes = []
    try:
        text = writer.run(html).markdown()
    except (AssertionError, ValueError, RecursionError):
        text = ""
        writer.flat = True
    if writer.flat or getattr(writer, "cut", False):
        codes.append("unsupported-structure")
    if not text:
        codes.append("body-missing")
    if writer.counts["missing"] or writer.lost_image:
        codes.append("asset-incomplete")
    if writer.counts["encrypted"] or writer.counts["embedded"]:
        codes.append("unresolved-embedded-content")
    return {"markdown": text, "quality": "degraded" if codes else "full", "degradations": ",".join(codes)} | {f"n_{k}": v for k, v in writer.counts.items()} | {k: "\n".join(v) for k, v in writer.seen.items()}


_SCHEMA = "markdown string, quality string, degradations string, n_todo long, n_media long, n_missing long, n_encrypted long, n_lost long, n_embedded long, remote_images string, internal_links string, external_links string, crypt_blocks string"


def html_job(df: DataFrame, key: str, html: str = "html", resources: str | None = None, pick: bool = False, carry: list[str] | None = None) -> DataFrame:
    """key, the carried columns, and what to_markdown gives for each row; one pass, no shuffle. resources: a column of a map from content hash to name. pick: of the page's body only."""
    kinds, carried = dict(df.dtypes), [key, *(carry or [])]
    columns = [*carried, html] + ([resources] if resources else [])

    told = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bodies = part.column(len(carried)).to_pylist()
                maps = part.column(len(carried) + 1).to_pylist() if resources else [None] * len(bodies)
                rows = [to_markdown(body_of(h) if pick else h, dict(m) if m is not None else None) for h, m in zip(bodies, maps, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], *(pa.array([r[c] for r in rows], kind) for c, kind in told)], [*carried, *(c for c, _ in told)])

    return df.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carried) + f", {_SCHEMA}")


def html_to_markdown(pages: DataFrame, key: str = "source_position") -> DataFrame:
    """The picked body of each page as Markdown."""
    return html_job(pages, key, pick=True)


def enml_to_html(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """Note bodies (html) with their resources (names by hash) as Markdown: to-dos, media, missing ones and encrypted blocks are each counted, links and remote images listed."""
    return html_job(notes, key, "html", "names")


def rewrite_wikilinks(notes: DataFrame, targets: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """notes (note_id, markdown and the carried columns) with [text](note:guid) turned into [[file|text]] where the guid is known; other links stay.

    Carried columns go with a note's first piece, so that nobody has to make the notes again to join them. Links are exploded, joined by guid and put together again in order, so no map of all notes is held anywhere.
    """
    pattern = r"\[([^\]]*)\]\(note:([0-9a-f-]{36})\)"
    parts = F.split("markdown", pattern, -1)
    found = F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0))
    carried = carry or []
    pieces = notes.select("note_id", F.struct(F.lit(0).alias("at_"), *carried).alias("rest"), F.posexplode(F.arrays_zip(parts.alias("before"), found.alias("link"))).alias("nth", "p"))
    pieces = pieces.withColumn("rest", F.when(F.col("nth") == 0, F.col("rest"))).withColumn("guid", F.regexp_extract("p.link", pattern, 2))
    met = pieces.join(targets.groupBy("guid").agg(F.min("file").alias("file")), "guid", "left")
    link = F.when(F.col("file").isNotNull(), F.concat(F.lit("[["), F.col("file"), F.lit("|"), F.regexp_extract("p.link", pattern, 1), F.lit("]]"))).otherwise(F.coalesce("p.link", F.lit("")))
    rows = met.select("note_id", "rest", F.struct("nth", F.concat("p.before", link).alias("t")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "").alias("markdown")
    whole = rows.groupBy("note_id").agg(joined, F.first("rest", ignorenulls=True).alias("rest"))
    return whole.select("note_id", "markdown", *(F.col("rest")[c].alias(c) for c in carried))
