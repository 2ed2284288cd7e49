"""Field candidates, OCR lines and reviews of single deeds as set operations.
All groups are at most one document; none is collected whole but for the words
of a page, whose clustering depends on their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def agreement_boost(candidates: DataFrame, number: Column, step: float = 0.05) -> DataFrame:
    """(doc, field, score, ...): a candidate whose number another candidate of
    the field shares gains `step`; those without a number never do."""
    shared = F.count("*").over(Window.partitionBy("doc", "field", number)) > 1
    return candidates.withColumn("score", F.col("score") + F.when(shared & (number != ""), step).otherwise(0.0))


def number_sets(candidates: DataFrame, firm: float = 0.80) -> DataFrame:
    """(doc, numbers array, preferred, score, page, ordinal) -> doc, chosen,
    conflict. Preferred sets, where there are any, are the only ones looked at;
    the largest wins, then score, page and order. Another set conflicts if it
    scores `firm` or more and neither contains the chosen one nor lies in it."""
    n, own = F.col("numbers"), Window.partitionBy("doc")
    order = own.orderBy(F.desc("preferred"), F.desc(F.size(n)), F.desc("score"), "page", "ordinal")
    rows = candidates.withColumns({"any": F.bool_or("preferred").over(own), "chosen": F.first("numbers").over(order)})
    apart = (F.size(F.array_except(n, "chosen")) > 0) & (F.size(F.array_except("chosen", n)) > 0)
    clash = (F.col("preferred") == F.col("any")) & (F.col("score") >= firm) & apart
    return rows.groupBy("doc").agg(F.first("chosen").alias("chosen"), F.bool_or(clash).alias("conflict"))


def first_page_list(found: DataFrame) -> DataFrame:
    """(doc, page, ordinal, value) -> doc, listed: the distinct values of the
    first page that has any, in order; several are a list, never a conflict."""
    once = found.groupBy("doc", "page", "value").agg(F.min("ordinal").alias("ordinal"))
    pages = once.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).alias("v"))
    return pages.groupBy("doc").agg(F.min_by("v", "page").alias("v")).select("doc", F.col("v.value").alias("listed"))


def text_blocks(lines: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """(doc, line_no, text) -> doc, block, lines, content: a block runs from a
    starting line to before the next start or ending line."""
    upto = Window.partitionBy("doc").orderBy("line_no")
    marked = lines.withColumns({"block": F.sum(starts.cast("long")).over(upto), "ends": ends.cast("int")})
    closed = F.sum("ends").over(Window.partitionBy("doc", "block").orderBy("line_no"))
    kept = marked.withColumn("closed", closed).where("block > 0 and closed = 0")
    said = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return kept.groupBy("doc", "block").agg(F.count("*").alias("lines"), F.array_join(said["text"], " ").alias("content"))


def evidence_line(values: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, value), (doc, line_no, text) -> doc, line_no, exact: the first line
    that holds the value, else the first with most of its words (two or more
    letters or digits); no row where none has any."""
    value, line = F.lower("value"), F.lower("text")
    words = F.array_distinct(F.regexp_extract_all(value, F.lit("[a-z0-9]{2,}"), F.lit(0)))
    held = lines.join(values.withColumn("words", words), "doc").withColumn("exact", line.contains(value))
    shared = F.size(F.filter("words", lambda w: F.contains(F.lower("text"), w)))
    scored = held.withColumn("shared", F.when(F.col("exact"), 2**30).otherwise(shared)).where("shared > 0")
    top = F.max(F.struct("shared", (-F.col("line_no")).alias("before"), "exact")).alias("m")
    return scored.groupBy("doc").agg(top).select("doc", (-F.col("m.before")).alias("line_no"), "m.exact")


def word_lines(words: DataFrame, least: int = 12, share: float = 0.8) -> DataFrame:
    """(doc, page, text, score, x_min, y_center, height) -> doc, page, line_no,
    text, score. Words go, from the top, to the first line whose mean place is
    within max(least, share of the median word height)."""
    said = F.struct("text", "score", "x_min", "y_center", "height")
    pages = words.groupBy("doc", "page").agg(F.collect_list(said).alias("words"))
    return neighbouring_word_lines(pages.select("doc", "page", F.inline("words")), least, share)


_WORD = {"doc": "long", "page": "long", "text": "string", "score": "double", "x_min": "double", "y_center": "double", "height": "double"}
_LINE = pa.schema([("doc", pa.int64()), ("page", pa.int64()), ("line_no", pa.int64()), ("text", pa.string()), ("score", pa.float64())])


def neighbouring_word_lines(words: DataFrame, least: int = 12, share: float = 0.8) -> DataFrame:
    """`word_lines` where the words of a page are rows next to each other, in one
    partition. Batches of words are worked on, not pages; only a page that a
    batch cuts is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = int(_page_starts(batch)[-1])
            if last == 0 and (not held or _same_page(held[-1], batch)):
                held.append(batch)  # one page so far
                continue
            if held and not _same_page(held[-1], batch):
                yield _lines(held, least, share)
                held = []
            if last:
                yield _lines([*held, batch.slice(0, last)], least, share)
            held = [batch.slice(last)]
        if held:
            yield _lines(held, least, share)

    rows = words.select(*[F.col(c).cast(kind).alias(c) for c, kind in _WORD.items()])
    return rows.mapInArrow(run, "doc long, page long, line_no long, text string, score double")


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _page_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a page's words begin; a null doc or page is a value of its own."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in ("doc", "page"):
        c = rows.column(name)
        for v in (_values(pc.fill_null(c, 0)), _values(pc.is_null(c))):
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _same_page(before: pa.RecordBatch, after: pa.RecordBatch) -> bool:
    """Whether the last word of one batch and the first of the next share a page."""
    return all(before.column(c)[before.num_rows - 1].as_py() == after.column(c)[0].as_py() for c in ("doc", "page"))


def _lines(batches: list[pa.RecordBatch], least: int, share: float) -> pa.RecordBatch:
    """The lines of whole pages."""
    rows = pa.Table.from_batches(batches)
    n, starts = rows.num_rows, _page_starts(rows)
    sizes = np.diff(starts, append=n)
    page = np.repeat(np.arange(len(starts)), sizes)
    x, y, height, score = (_values(rows.column(c)) for c in ("x_min", "y_center", "height", "score"))
    median = np.minimum.reduceat(height, starts)
    for i in np.flatnonzero(~(median == np.maximum.reduceat(height, starts))):
        median[i] = np.nanmedian(height[starts[i] : starts[i] + sizes[i]])
    near = np.maximum(least, np.trunc(share * median))
    # from here on in order of page, place from the top and from the left
    order = np.lexsort((x, y, page))
    down = y[order]
    # a step of more than `near` begins a line wherever the mean is; the loop sees what a step alone doesn't settle
    new = np.ones(n, bool)
    new[1:] = (page[1:] != page[:-1]) | (np.diff(down) > near[page[1:]] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], n)
    wide = ~(down[ends - 1] - down[begins] <= near[page[begins]] - 1)
    for begin, end in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
        limit, total, k = float(near[page[begin]]), 0.0, 0
        for i, v in enumerate(down[begin:end].tolist(), begin):  # in rising order, so a line left behind is never near again
            if k and v - total / k > limit:
                new[i], total, k = True, 0.0, 0
            total, k = total + v, k + 1
    begins = np.flatnonzero(new)
    order = order[np.lexsort((x[order], np.cumsum(new)))]
    score = score[order]
    known = ~np.isnan(score)
    with np.errstate(invalid="ignore"):
        mean = np.add.reduceat(np.where(known, score, 0.0), begins) / np.add.reduceat(known.astype(np.int64), begins)
    texts = rows.column("text").combine_chunks().take(pa.array(order))
    bounds = pa.array(np.append(begins, n), pa.int32())
    first = pa.array(starts[page[begins]])
    line_no = np.arange(len(begins)) - np.searchsorted(begins, starts)[page[begins]] + 1
    text = pc.binary_join(pa.ListArray.from_arrays(bounds, texts), " ")
    columns = [*(rows.column(c).combine_chunks().take(first) for c in ("doc", "page")), pa.array(line_no, pa.int64()), text, pa.array(mean, from_pandas=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_LINE)


def page_type(page: Column, last: Column) -> Column:
    """What a page of a deed is, by its place; the first match holds."""
    return F.when(page == 1, "stamp_metadata").when(page == 2, "property_schedule").when(page == last, "registration_plan").otherwise("deed_text")


def handwritten(text: Column, score: Column, height: Column, printed: str) -> Column:
    """Whether a line may be handwriting: digits in the top 16% of the page, or
    a short line read with little confidence that isn't printed wording."""
    doubtful = (score < 0.72) & F.length(text).between(3, 70) & ~F.lower(text).rlike(printed)
    return ((height <= 0.16) & text.rlike("[0-9]")) | doubtful


def payload_changes(old: DataFrame, form: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after: what a clerk's form changes; blank entries
    change nothing. Rows are joined once and unpivoted after that."""
    new = form.select(F.col(key), *[F.col(f).alias(f"{f}_new") for f in fields])
    each = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), F.trim(F.col(f"{f}_new").cast("string")).alias("after")) for f in fields]
    rows = old.join(new, key).select(key, F.inline(F.array(*each)))
    return rows.where((F.col("after") != "") & ~F.trim("before").eqNullSafe(F.col("after")))


def decide(action: Column, duplicate: Column, failed: Column, reason: Column, checked: Column | None = None, current: Column | None = None) -> Column:
    """struct(status, message) after a reviewer's action; null status where it
    is refused. Warnings alone never block an approval. checked: the status by
    new checks, which a correction takes. current: the status before; a sealed
    record can only be rejected."""
    def to(status: str | None, message: str) -> Column:
        return F.struct(F.lit(status).cast("string").alias("status"), F.lit(message).alias("message"))

    reject = F.when(F.coalesce(F.trim(reason), F.lit("")) == "", to(None, "a reason is needed")).otherwise(to("REJECTED", "rejected"))
    approve = F.when(duplicate, to(None, "duplicate")).when(failed, to(None, "critical check failed")).otherwise(to("APPROVED", "sealed"))
    made = (
        F.when(action == "reject", reject).when(action == "approve", approve)
        .when(action == "submit_to_officer", to("READY_FOR_APPROVAL", "sent"))
    )
    if checked is not None:
        made = made.when(action == "correct", F.struct(checked.alias("status"), F.lit("corrected").alias("message")))
    made = made.otherwise(to(None, "unknown action"))
    if current is None:
        return made
    return F.when((current == "APPROVED") & ~F.coalesce(action == "reject", F.lit(False)), to(None, "already sealed")).otherwise(made)


def timeline(records: DataFrame, key: str, events: dict[str, Column]) -> DataFrame:
    """key, step, event, at: the lifecycle events of a record that have a time."""
    steps = [F.struct(F.lit(i).cast("long").alias("step"), F.lit(name).alias("event"), at.alias("at")) for i, (name, at) in enumerate(events.items(), 1)]
    return records.select(key, F.inline(F.array(*steps))).where("at is not null")


def alike(x: str | None, y: str | None) -> bool:
    """Whether two values are spellings of one: equal, or one within the other
    if both are longer than four, or alike by 0.72; never if digits differ."""
    from difflib import SequenceMatcher

    if x is None or y is None or x == y:
        return x is not None and x == y
    if any(c.isdigit() for c in x + y):
        return False
    return (min(len(x), len(y)) > 4 and (x in y or y in x)) or SequenceMatcher(None, x, y).ratio() >= 0.72


@F.pandas_udf(BooleanType())
def spelling_variant(a: pd.Series, b: pd.Series) -> pd.Series:
    """`alike` of two columns."""
    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def heatmap(records: DataFrame, key: str) -> DataFrame:
    """key, bbox, polygon, confidence of every line of every page that has a
    place; a confidence that can't be read is the recogniser's."""
    lines = records.select(key, F.explode("pages").alias("p")).select(key, F.explode("p.lines").alias("l"))
    placed = (F.coalesce(F.size("l.bbox"), F.lit(0)) > 0) | (F.coalesce(F.size("l.polygon"), F.lit(0)) > 0)
    score = F.coalesce(F.col("l.confidence").try_cast("double"), F.col("l.rec_score").try_cast("double"))
    return lines.where(placed).select(key, "l.bbox", "l.polygon", score.alias("confidence"))


def new_words(lines: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Words (key, text) that no line of the key says already, case aside."""
    there = lines.select(F.col(key).alias("there"), F.lower("text").alias("said")).distinct()
    return words.join(there, (F.col(key) == F.col("there")) & (F.lower("text") == F.col("said")), "left_anti")


# Wording around signatures.
SIGNATURE_WORDS = "signature|signed|witness|thumb|l\\.t\\.i|executant"


def signature_line(text: Column, y_rel: Column) -> Column:
    """Whether a line of the lowest quarter of a page speaks of a signature."""
    return (y_rel >= 0.75) & F.lower(text).rlike(SIGNATURE_WORDS)


def harmonised(semantic: dict[str, Column], neural: dict[str, Column]) -> dict[str, Column]:
    """Values of the rules, and the model's where the rules have none."""
    return {f: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(neural.get(f, F.lit(None).cast("string"))), F.lit(""))) for f, c in semantic.items()}


def by_class(values: Column, classes: Column) -> Column:
    """Values in order of their class, equal classes as they come."""
    items = F.transform(F.arrays_zip(classes.alias("k"), values.alias("v")), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v")))
    return F.transform(F.array_sort(items), lambda x: x["v"])


def provenance_hint(value: Column, entry: Column) -> Column:
    """struct(extracted, raw, normalised, page, confidence, box) that a field's
    entry of its provenance says beside the value. `entry` is a map of texts
    under any of the names that such entries have; the raw reading is the
    normalised value's only where they differ; a box has four numbers."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at(entry, F.lit(n))), F.lit("")) for n in names])
    told = F.nullif(F.trim(value), F.lit(""))
    there = told.isNotNull()
    raw, box = first("raw_ocr_value", "original_value"), F.from_json(first("source_bbox", "bounding_box", "bbox"), "array<int>")
    shown = lambda c: F.when(there, c)
    return F.struct(
        there.alias("extracted"), shown(raw).alias("raw"), F.when(there & raw.isNotNull() & (raw != told), told).alias("normalised"),
        shown(first("page_number", "page")).alias("page"), shown(F.round(first("ocr_confidence", "confidence").try_cast("double"), 2)).alias("confidence"),
        F.when(there & (F.size(box) == 4), box).alias("box"),
    )


def raw_reading(*places: Column) -> Column:
    """struct(reading, available): the first place that holds a raw reading."""
    found = F.coalesce(*places)
    return F.struct(found.alias("reading"), found.isNotNull().alias("available"))
