"""Packing, lists, tables, pages and quality checks of block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import strip, words


def pack_chunks(blocks: DataFrame, target: int = 2000) -> DataFrame:
    """doc_id, chunk_idx, first_block, last_block, n_words of chunks of at most ``target`` words, unless one block has more.

    A heading starts a chunk, and so does a block that would pass the target. Each document is a fold over its
    blocks in order, documents are folded in parallel.
    """
    item = F.struct("block_idx", (F.col("style") != "Normal").alias("head"), F.size(words(F.col("text"))).alias("n"))
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    kind = "array<struct<first_block:int,last_block:int,n_words:int>>"
    chunk = lambda a, b, n: F.array(F.struct(a.cast("int").alias("first_block"), b.cast("int").alias("last_block"), n.cast("int").alias("n_words")))

    def step(acc: Column, x: Column) -> Column:
        opens = (F.size(acc) == 0) | x["head"] | (F.get(acc, F.size(acc) - 1)["n_words"] + x["n"] > target)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), chunk(F.get(acc, F.size(acc) - 1)["first_block"], x["block_idx"], F.get(acc, F.size(acc) - 1)["n_words"] + x["n"]))
        return F.when(opens, F.concat(acc, chunk(x["block_idx"], x["block_idx"], x["n"]))).otherwise(grown)

    packed = F.aggregate("b", F.expr(f"cast(array() as {kind})"), step)
    return rows.select("doc_id", F.posexplode(packed).alias("chunk_idx", "c")).select("doc_id", "chunk_idx", "c.*")


#: Aligned blocks of 1, 2, 4, ... pages: [first, last] is a union of at most two blocks of each size.
_LOW, _HIGH = "shiftright(a + shiftleft(1L, l) - 1, l)", "shiftright(b, l)"
_BLOCK = "if({high} > {low} and {edge} % 2 = 1, named_struct('level', l, 'block', {edge} - {back}), null)"
COVER = f"flatten(transform(sequence(0, 31), l -> filter(array({_BLOCK.format(high=_HIGH, low=_LOW, edge=_LOW, back=0)}, {_BLOCK.format(high=_HIGH, low=_LOW, edge=_HIGH, back=1)}), x -> x is not null)))"


def attach_by_page(items: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, item_id, section_idx: the last section whose pages contain the item's, else the last that starts at or before
    it, else the first; items of documents without sections are left out.

    Only distinct pages meet sections. A section's pages are cut into aligned blocks, two of each size at most, and a page
    lies in one block of each size, so containment is an equality of blocks; the last section that has started is a
    running maximum over starts and pages. Rows between stages grow with items + sections (times the bits of a page number).
    Pages count from 0; an item without a page gets the first section.
    """
    spans = sections.select("doc_id", "section_idx", F.greatest(F.col("page_start").cast("long"), F.lit(0)).alias("s"), (F.col("page_end").cast("long") + 2).alias("b"), F.col("page_start").cast("long").alias("start"))
    pages = items.select("doc_id", F.col("page").cast("long").alias("page")).distinct()
    cover = spans.filter("s is not null and b is not null").withColumn("a", F.col("s") + 1).select("doc_id", "section_idx", F.explode(F.expr(COVER)).alias("c"))
    last = cover.groupBy("doc_id", "c").agg(F.max("section_idx").alias("inside"))
    blocks = F.expr("transform(sequence(0, cast(floor(log2(page + 1)) as int)), l -> named_struct('level', l, 'block', shiftright(page + 1, l)))")
    inside = pages.filter("page >= 0").select("doc_id", "page", F.explode(blocks).alias("c")).join(last, ["doc_id", "c"]).groupBy("doc_id", "page").agg(F.max("inside").alias("inside"))
    points = spans.select("doc_id", F.lit(None).cast("long").alias("page"), F.col("start").alias("at"), "section_idx", F.lit(False).alias("asked"))
    points = points.unionByName(pages.select("doc_id", "page", F.col("page").alias("at"), F.lit(None).cast("int").alias("section_idx"), F.lit(True).alias("asked")))
    upto = F.max(F.when(F.col("at").isNotNull(), F.col("section_idx"))).over(Window.partitionBy("doc_id").orderBy("at"))
    started = points.withColumn("started", upto).filter("asked").select("doc_id", "page", "started")
    first = sections.groupBy("doc_id").agg(F.min("section_idx").alias("first"))
    found = started.join(first, "doc_id").join(inside, ["doc_id", "page"], "left").select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.coalesce("inside", F.when(F.col("page").isNotNull(), F.col("started")), "first").alias("section_idx"))
    same = (F.col("doc_id") == F.col("_doc")) & F.col("page").cast("long").eqNullSafe(F.col("_page"))
    return items.select("doc_id", "item_id", "page").join(found, same).select("doc_id", "item_id", "section_idx")


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_idx, n_cells, cells (joined by tab) of lines that begin with ``|``; consecutive lines are a table, separator rows are left out."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("s", strip(F.col("line"))).filter(F.col("s").startswith("|"))
    lines = lines.withColumn("island", F.col("line_no") - F.row_number().over(order)).filter(~F.col("s").rlike(r"^[|\s:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("s", r"^\||\|$", ""), r"\|"), strip)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    within = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("line_no")) - 1
    return lines.select("doc_id", rank.alias("table_idx"), within.alias("row_idx"), F.size(cells).alias("n_cells"), F.array_join(cells, "\t").alias("cells"))


def group_runs(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, first_block, type, n_blocks, text: neighbouring blocks of one listed type as one; others stay alone."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    opens = (F.col("type") != F.coalesce(F.lag("type").over(order), F.lit(""))) | ~F.col("type").isin(kinds)
    rows = blocks.withColumn("run", F.sum(opens.cast("int")).over(order))
    out = rows.groupBy("doc_id", "run", "type").agg(F.min("block_idx").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"), F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("l"))
    return out.select("doc_id", "first_block", "type", "n_blocks", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def pipeline_score(runs: DataFrame) -> DataFrame:
    """variant, mean_score, n: 0.45 retention + 0.20 sections / 8 + 0.20 citations / 10 + 0.15 artifact - 0.10 warnings / 10, parts within 0 to 1."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = 0.45 * unit(F.col("out_words") / F.greatest(F.lit(1), F.col("src_words"))) + 0.20 * unit(F.col("sections") / 8) + 0.20 * unit(F.col("citations") / 10) + 0.15 * F.col("artifact").cast("int") - 0.10 * unit(F.col("warnings") / 10)
    return runs.select("variant", unit(score).alias("s")).groupBy("variant").agg(F.round(F.avg("s"), 4).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def retention_check(before: DataFrame, after: DataFrame, share: float = 0.65) -> DataFrame:
    """doc_id, n_before, n_after, warn: fewer paragraphs are left than a share of the source's, and than one."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), "doc_id", "left").na.fill(0, ["n_after"])
    return both.withColumn("warn", F.col("n_after") < F.greatest(F.lit(1), F.floor(F.col("n_before") * share)))


def block_id_errors(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, problem, block_id: blocks without an id (``no id``, one row a block), ids that several blocks of a document have
    (``duplicate``) and ids that ``found`` lacks (``missing``). Both tables have doc_id and block_id; blank ids are none."""
    clean = F.nullif(strip(F.coalesce(F.col("block_id").cast("string"), F.lit(""))), F.lit(""))
    rows = blocks.select("doc_id", clean.alias("block_id"))
    named = rows.filter("block_id is not null").groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n"))
    problem = lambda df, name: df.select("doc_id", F.lit(name).alias("problem"), "block_id")
    there = found.select("doc_id", clean.alias("block_id")).filter("block_id is not null").distinct()
    return problem(rows.filter("block_id is null"), "no id").union(problem(named.filter("n > 1"), "duplicate")).union(problem(named.join(there, ["doc_id", "block_id"], "left_anti"), "missing"))
