"""Plots, areas and addresses read from the text of whole pages: matches with
their places, judged by the words around them.

pages: (doc, page, text, scores): the lines of a page joined by line ends, and
how sure the recogniser was of each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as at
from ..functions.geometry import SQYD_SQM
from ..functions.text import clean_address, collapse

# Scores, windows, and widths of roads that are no plots.
PLAN_SCORE, SCHEDULE_SCORE, OTHER_SCORE, SEVERAL = 1.05, 0.95, 0.88, 0.05
PLOT_BEFORE, PLOT_AFTER, AREA_AROUND = 40, 25, 160
ROAD_WIDTHS = ("20", "30", "40", "50", "60", "80", "100", "500")
# Words that an address is left without.
PARTY_WORDS = (
    r"\bin\s*favour\s*of\b", r"\bhereinafter\s*called\b", r"\bthe\s+vendors?\b", r"\bthe\s+vendees?\b", r"\bprincipals?\b", r"\battorneys?\b",
    r"\bvendor/principal\b", r"\bvendee/attorney\b", r"\bvendees/\s*attorneys\b", r"\(hereinafter called.*?\)",
    r"\boccup(?:ation)?\b", r"\bage\b", r"\br/o\.?\b",
)

_NUMBER = r"[0-9]{1,4}(?:/[0-9A-Za-z]{1,3})?"
_PLOT = rf"(?i)\b(?:house\s+plot|plot|sub[- ]?(?:survey|division)|site|marked\s+as)s?[\s.:-]*(?:(?:nos?|numbers?)\b)?[\s.:-]*{_NUMBER}(?:\s*(?:,|&|\+|\band\b)\s*{_NUMBER})*"
_NEIGHBOUR = r"(?i)\b(?:north|south|east|west|bounded|boundary|boundaries)\b"
_DOOR = r"(?i)\b(?:h\.?\s*no|door|d\.?\s*no|flat|room)\b"
_ROAD = r"(?i)\b(?:wide|road|feet|ft)\b"
_AMOUNT = r"[0-9]+(?:\.[0-9]+)?"
_YARDS = r"sq[.\s]*(?:yards?|yds?)"
_METRES = r"sq[.\s]*(?:metres?|meters?|mtrs?|mts?)"
# an amount may have one letter that was read for a nought
_AREA = rf"(?i)\b(?:{_AMOUNT}|[0-9]{{2,4}}[@B](?:\.[0OB])?)\s*{_YARDS}\b(?:[^0-9]{{0,40}}?\b{_AMOUNT}\s*{_METRES}\b)?"
_ACRES = r"(?i)\bac\.?\s*[0-9]+[-\s][0-9]+\s*(?:gts|guntas)\b"


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc, page, ordinal, text, score) -> pages."""
    said = F.sort_array(F.collect_list(F.struct("ordinal", "text", "score")))
    return lines.groupBy("doc", "page").agg(said.alias("s")).select("doc", "page", F.array_join("s.text", "\n").alias("text"), F.col("s.score").alias("scores"))


def _layout(text: Column) -> tuple[Column, Column]:
    """Whether a page is a plan, and whether it is a schedule of property."""
    dense = F.regexp_replace(F.upper(text), r"[.\s]+", "")
    has = lambda *words: F.array_min(F.array(*[dense.contains(w) for w in words]))
    plan = has("REGISTRATIONPLAN") | has("LOCATIONPLAN") | has("PLANSHOWING") | (has("PLAN") & (has("PLOT") | has("SYNOS")))
    return plan, has("SCHEDULE", "PROPERTY")


def _each(pages: DataFrame, pattern: str) -> DataFrame:
    """One row per match, with the page it is on and the score of its line."""
    rows = pages.select("*", F.explode(at.spans(F.col("text"), pattern)).alias("m")).select("*", "m.*").drop("m")
    return rows.withColumn("line_score", F.coalesce(F.get("scores", at.line_of(F.col("text"), F.col("start"))), F.lit(0.85)))


def plot_numbers(value: Column) -> Column:
    """Numbers of a list as written. Where one has a part behind a slash, bare
    ones of up to three digits are parts of the number before them, unless they
    begin with a nought, and longer ones are none; else years and widths of
    roads are none."""
    items = F.regexp_extract_all(F.regexp_replace(value, r"^[^0-9]*", ""), F.lit(_NUMBER), F.lit(0))
    slashed = F.exists(items, lambda x: x.contains("/"))
    state = F.struct(F.lit("").alias("base"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        own = x.contains("/")
        base = F.when(own, F.substring_index(x, "/", 1)).otherwise(s["base"])
        part = (F.length(x) <= 3) & (s["base"] != "") & ~((F.length(x) > 1) & x.startswith("0"))
        add = F.when(own, F.array(x)).when(part, F.array(F.concat(s["base"], F.lit("/"), x))).otherwise(F.array().cast("array<string>"))
        return F.struct(base.alias("base"), F.concat(s["out"], add).alias("out"))

    parts = F.aggregate(items, state, step, lambda s: s["out"])
    bare = F.filter(items, lambda x: ~x.rlike("^(19|20)[0-9]{2}$") & ~x.isin(*ROAD_WIDTHS))
    return F.array_distinct(F.when(slashed, parts).otherwise(bare))


def plots(pages: DataFrame) -> DataFrame:
    """(doc, page, start, items, value, score, reason): plots that a page names.
    Those behind a word of boundaries are a neighbour's, those behind a door's
    are a house, and what is wide or a road is neither; each is judged by the
    characters around it, so one line can hold both kinds."""
    plan, schedule = _layout(F.col("text"))
    found = _each(pages.withColumns({"plan": plan, "schedule": schedule}), _PLOT)
    # within its own sentence: what a full stop or line end divides says nothing of it
    lead = F.element_at(F.split(at.before(F.col("text"), F.col("start"), PLOT_BEFORE), r"\.\s+(?=[A-Z])|\n", -1), -1)
    trail = at.after(F.col("text"), F.col("end"), PLOT_AFTER)
    items = plot_numbers(F.col("value"))
    found = found.where(~lead.rlike(_NEIGHBOUR) & ~lead.rlike(_DOOR) & ~trail.rlike(_ROAD)).withColumn("items", items)
    base = F.when(F.col("plan"), PLAN_SCORE).when(F.col("schedule"), SCHEDULE_SCORE).otherwise(OTHER_SCORE)
    score = F.round(base + F.when(F.size("items") > 1, SEVERAL).otherwise(0.0), 4)
    reason = F.when(F.col("plan"), "plan").when(F.col("schedule"), "schedule").otherwise("text")
    rows = found.select("doc", "page", "start", "items", F.array_join("items", ", ").alias("value"), score.alias("score"), reason.alias("reason"))
    return rows.where(F.length("value") > 2)


def resolved_plots(found: DataFrame, firm: float = 0.85) -> DataFrame:
    """doc, value, score, status, needs_review, conflicting of `plots`: of those
    that name several the one of most, else the surest; ties by score, page and
    place. Another of `firm` or more whose numbers don't all lie in the chosen
    one is a conflict, and then all are listed."""
    own = Window.partitionBy("doc")
    n = F.when(F.size("items") > 1, F.size("items")).otherwise(0)
    first = F.first(F.struct("items", "value", "score")).over(own.orderBy(F.desc(n), F.desc("score"), "page", "start"))
    rows = found.withColumn("best", first)
    apart = (F.col("score") >= firm) & (F.size(F.array_except("items", "best.items")) > 0)
    said = F.array_sort(F.collect_list(F.struct("page", "start", "value")))["value"]
    out = rows.groupBy("doc").agg(F.first("best").alias("best"), F.bool_or(apart).alias("conflict"), said.alias("all"))
    status = F.when(F.col("conflict"), "CONFLICT").otherwise("EXTRACTED")
    listed = F.when(F.col("conflict"), F.col("all")).otherwise(F.array().cast("array<string>"))
    return out.select(
        "doc", F.col("best.value").alias("value"), F.round("best.score", 2).alias("score"), status.alias("status"), F.col("conflict").alias("needs_review"), listed.alias("conflicting")
    )


def areas(pages: DataFrame) -> DataFrame:
    """(doc, page, start, yards, metres, value, score, reason): areas in square
    yards, with the metres that follow them or else converted. Words around an
    area say what it is of, and by that how sure it is; a letter read for a
    nought costs confidence; land in acres is another holding and scores 0."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    found = _each(pages, _AREA)
    lead, trail = F.lower(at.before(text, start, AREA_AROUND)), F.lower(at.after(text, end, AREA_AROUND))
    near = F.substring(lead, F.greatest(F.length(lead) - 40, F.lit(0)) + 1, F.lit(40))
    head = F.regexp_extract("value", r"^[0-9@B.O]+", 0)
    repaired = head.rlike("[@BO]")
    yards = F.translate(head, "@BO", "000").cast("double")
    told = F.regexp_extract("value", rf"(?i)({_AMOUNT})\s*{_METRES}$", 1)
    metres = F.coalesce(F.nullif(told, F.lit("")).cast("double"), F.round(yards * SQYD_SQM, 1))
    s = F.col("line_score").cast("double")
    bounded = lambda c: F.when(s >= 0.8, F.least(F.lit(c), s + 0.05)).otherwise(F.least(F.lit(c), s))
    rules = [
        (repaired, F.least(F.lit(0.76), s * 0.80), "ocr-tolerant repair"),
        (near.rlike(r"extent\s+of\s*$"), F.least(F.lit(1.05), s + 0.08), "schedule extent"),
        (near.rlike(r"plot\s*area\s*[:-]?\s*$"), F.least(F.lit(0.98), s + 0.02), "plan area"),
        (lead.rlike(r"piece\s+of\s+land[^0-9]*measuring[^0-9]*$"), F.least(F.lit(0.98), s + 0.03), "piece of land"),
        (lead.rlike(r"ad-?measuring|offered to sell"), bounded(0.99), "described"),
        (lead.rlike(r"property being sold|property sold|sold property|schedule property"), bounded(0.95), "sold"),
        (lead.contains("plot") | trail.contains("plot"), bounded(0.90), "of a plot"),
        (lead.rlike("plan|schedule|drawing"), bounded(0.85), "plan or schedule"),
    ]
    score, reason = bounded(0.60), F.lit("alone")
    for test, value, name in reversed(rules):
        score, reason = F.when(test, value).otherwise(score), F.when(test, name).otherwise(reason)
    plain = lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")
    value = F.concat(plain(F.col("yards")), F.lit(" sq. yards ("), plain(F.col("metres")), F.lit(" sq. metres)"))
    rows = found.withColumns({"yards": yards, "metres": metres, "score": F.round(score, 4), "reason": reason})
    rows = rows.select("doc", "page", "start", "yards", "metres", value.alias("value"), "score", "reason")
    none = F.lit(None).cast("double")
    acres = _each(pages, _ACRES).select("doc", "page", "start", none.alias("yards"), none.alias("metres"), F.trim("value").alias("value"), F.lit(0.0).alias("score"), F.lit("acres").alias("reason"))
    return rows.unionByName(acres)


def residual_address(block: Column, *parts: Column) -> Column:
    """The address in a party's block of text: what is left without its name,
    relation, age and occupation (`parts`), the wording of deeds, list numbers
    and identity numbers, cut at full stops; pieces of no word of three letters
    and no number of three digits go, house numbers come first and postal codes
    last. Null if nothing is left."""
    rest = at.without(block, F.array(*parts))
    for words in PARTY_WORDS:
        rest = F.regexp_replace(rest, f"(?i){words}", "")
    rest = F.regexp_replace(rest, r"^\s*(?:[0-9]+\s*[\])\.]|[Ii]\s*[,:\])-])", "")
    rest = F.regexp_replace(rest, r"(?i)\b(?:aadh?a?r|adhar|aadhaar|uid)\s*(?:card)?\s*(?:no\.?)?[:\s-]*[X0-9\s]{4,15}", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)\bH\.\s*No\.", "H_NO"), r"(?i)\bNo\.", "NO_")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[^A-Za-z0-9]+", ""), r"[^A-Za-z0-9]+$", "")
    whole = lambda c: F.regexp_replace(F.regexp_replace(c, r"\bH_NO\b", "H.No."), r"\bNO_", "No.")
    pieces = F.transform(F.split(rest, "[.;]+"), lambda c: bare(collapse(whole(F.btrim(c, F.lit(" ,;:-"))))))
    pieces = F.filter(pieces, lambda c: (F.length(c) > 3) & c.rlike(r"\b[A-Za-z]{3,}\b|\b[0-9]{3,}\b"))
    kind = lambda c: F.when(F.upper(c).rlike(r"H\.?NO"), 0).when(F.upper(c).rlike(r"\b[0-9]{6}\b|PIN CODE"), 2).otherwise(1)
    placed = F.array_sort(F.transform(pieces, lambda c, i: F.struct(kind(c).alias("k"), i.alias("i"), c.alias("c"))))
    return clean_address(F.nullif(F.array_join(F.transform(placed, lambda x: x["c"]), ", "), F.lit("")))
