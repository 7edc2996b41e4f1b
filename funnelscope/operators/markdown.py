"""Mining saved audit reports: every function works inside the report's own row.

Sections and bullets come from one regular-expression split of the whole text, so a long report
costs linear time and reports never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.arrays import last_by_key
from funnelscope.functions.text import fill, find, is_blank, let, lines, py_slice, strip, unix_lines
from funnelscope.functions.urls import company_name

SECTION_TYPE = "array<struct<heading:string,content:string>>"
ITEM_TYPE = "array<struct<observed:string,why:string,hypothesis:string,raw:string>>"


def _first_line(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _after_first_line(piece: Column) -> Column:
    return F.when(F.contains(piece, F.lit("\n")), F.regexp_replace(piece, "(?d)\\A[^\n]*\n", "")).otherwise(F.lit(""))


def md_sections(md: Column, level: int) -> Column:
    """(heading, content) pairs at exactly this heading level; an empty part stays only when it is the last."""
    mark = "#" * level + " "

    def part(piece):
        headed = piece.startswith(mark)
        heading = F.when(headed, strip(F.substring(_first_line(piece), F.lit(level + 2), F.length(piece)))).otherwise("")
        content = strip(F.when(headed, _after_first_line(piece)).otherwise(piece))
        return F.struct(heading.alias("heading"), content.alias("content"))

    def keep(parts):
        n = F.size(parts)
        return F.filter(parts, lambda p, i: (p["heading"] != "") | (p["content"] != "") | (i == n - 1))
    return let(F.transform(F.split(unix_lines(md), f"\n(?={mark})"), part), keep)


def md_bullets(md: Column) -> Column:
    """Top-level bullets with their continuation lines; text before the first bullet is dropped."""
    def bullet(piece):
        head = strip(F.substring(_first_line(piece), F.lit(3), F.length(piece)))
        more = F.filter(F.transform(F.split(_after_first_line(piece), "\n"), strip), lambda x: x != "")
        return F.array_join(F.concat(F.array(head), more), "\n")
    pieces = F.split(unix_lines(md), "\n(?=[-*] )")
    return F.transform(F.filter(pieces, lambda p: p.rlike(r"\A[-*] ")), bullet)


def layer_number(text: Column, fallback: Column) -> Column:
    digit = F.regexp_extract(text, r"(?U)Layer\s*([0-9])", 1)
    return F.when(digit.isin("1", "2", "3", "4", "5"), digit.try_cast("int")).otherwise(fallback)


def section_find(sections: Column, needles: list[str]) -> Column:
    """Content of the first heading holding any needle; of equal headings the last content counts."""
    named = F.try_element_at(F.filter(sections, lambda s: F.lower(s["heading"]).rlike(
        "|".join(rf"\Q{n}\E" for n in needles))), F.lit(1))["heading"]
    return let(named, lambda h: F.coalesce(
        F.try_element_at(F.filter(sections, lambda s: s["heading"] == h), F.lit(-1))["content"], F.lit("")))


def _last_per_layer(items: Column) -> Column:
    """Of structs with a ``layer``, the last one of each, in order of first appearance."""
    return last_by_key(items, lambda x: x["layer"])


def report_working(sections: Column) -> Column:
    label = r"(?U)\A\*\*Layer\s*\d[^*]*\*\*\s*[:\-—]?\s*"
    items = F.transform(md_bullets(section_find(sections, fv.WORKING_WORDS)), lambda b, i: F.struct(
        layer_number(b, i + 1).alias("layer"), F.regexp_replace(b, label, "").alias("text")))
    return _last_per_layer(items)


def _observation(bullet: Column) -> Column:
    hit = bullet.rlike(fv.OBSERVATION_PATTERN)
    group = lambda n: F.when(hit, strip(F.regexp_extract(bullet, fv.OBSERVATION_PATTERN, n)))
    return F.struct(group(1).alias("observed"), group(2).alias("why"), group(3).alias("hypothesis"),
                    F.when(~hit, bullet).alias("raw"))


def report_observations(sections: Column) -> Column:
    """``layer`` and its ``items`` (observed, why, hypothesis, or raw when the bullet has another shape)."""
    def items_of(content):
        loose = F.when(content != "", F.array(F.struct(
            *[F.lit(None).cast("string").alias(n) for n in ("observed", "why", "hypothesis")], content.alias("raw"))
        ).cast(ITEM_TYPE)).otherwise(F.array().cast(ITEM_TYPE))
        return let(md_bullets(content), lambda b: F.when(F.size(b) > 0, F.transform(b, _observation)).otherwise(loose))
    parts = F.transform(md_sections(section_find(sections, fv.OBSERVATION_WORDS), 3), lambda s, i: F.struct(
        s["heading"].alias("heading"), layer_number(s["heading"], i).alias("layer"), items_of(s["content"]).alias("items")))
    headed = F.transform(F.filter(parts, lambda p: p["heading"] != ""), lambda p: F.struct(p["layer"], p["items"]))
    return _last_per_layer(headed)


def _level(content: Column, group: int) -> Column:
    letter = F.lower(F.left(F.regexp_extract(content, fv.SCORE_PATTERN, group), F.lit(1)))
    word = F.lit("")
    for key, name in fv.SCORE_LETTERS.items():
        word = F.when(letter == key, F.lit(name)).otherwise(word)
    return word


def report_priorities(sections: Column) -> Column:
    """Title, rationale and the three levels; empty levels when no score line is found."""
    def priority(s):
        content = s["content"]
        unscored = strip(F.array_join(F.filter(lines(content), lambda x: ~x.rlike(fv.SCORE_PATTERN)), "\n"))
        return F.struct(
            F.regexp_replace(s["heading"], r"(?U)\A\d+[.)]\s*", "").alias("title"),
            F.when(content.rlike(fv.SCORE_PATTERN), unscored).otherwise(content).alias("rationale"),
            _level(content, 1).alias("impact"), _level(content, 2).alias("confidence"), _level(content, 3).alias("speed"))
    parts = md_sections(section_find(sections, fv.PRIORITY_WORDS), 3)
    return F.transform(F.filter(parts, lambda p: p["heading"] != ""), priority)


def report_data_questions(sections: Column) -> Column:
    return md_bullets(section_find(sections, fv.DATA_WORDS))


def mine_reports(reports: DataFrame, body: str = "markdown") -> DataFrame:
    """Adds ``working, observations, priorities, data, unparsed`` to reports."""
    s = F.col("sections")
    mined = reports.withColumn("sections", md_sections(F.col(body), 2)).withColumns({
        "working": report_working(s), "observations": report_observations(s),
        "priorities": report_priorities(s), "data": report_data_questions(s)})
    nothing = (F.size("working") == 0) & (F.size("observations") == 0) & (F.size("priorities") == 0)
    return mined.withColumn("unparsed", F.when(nothing, F.col(body)).otherwise("")).drop("sections")


def priority_top(priorities: Column, limit: int = fv.TOP_PRIORITIES) -> Column:
    """First priorities in document order, each level with its number (unknown is 0)."""
    def number(level):
        n = F.lit(0)
        for name, value in fv.SCORE_LEVELS.items():
            n = F.when(level == name, F.lit(value)).otherwise(n)
        return n
    return F.transform(F.slice(priorities, 1, limit), lambda p, i: F.struct(
        (i + 1).alias("rank"), p["title"].alias("title"), number(p["impact"]).alias("impact"),
        number(p["confidence"]).alias("confidence"), number(p["speed"]).alias("speed")))


def priority_rescore(priorities: Column) -> Column:
    """All priorities with impact x confidence x speed and the rank that product gives (ties keep document order)."""
    scored = F.transform(priority_top(priorities, 2**31 - 1), lambda p: F.struct(
        (-(p["impact"] * p["confidence"] * p["speed"])).alias("negated"), p["rank"].alias("rank"), p["title"].alias("title")))
    return F.transform(F.array_sort(scored), lambda p, i: F.struct(
        p["rank"].alias("rank"), p["title"].alias("title"), (-p["negated"]).alias("score"),
        (i + 1).alias("score_rank"), (p["rank"] == i + 1).alias("rank_agrees")))


def notes_clean(notes: Column) -> Column:
    """Drops one line of narration stuck in front of the first heading."""
    before = F.regexp_extract(notes, r"(?s)\A(.+?)(?<=[.!?:)])#{1,3} ", 1)
    glued = (before != "") & ~F.contains(strip(before), F.lit("\n")) & ~notes.rlike(r"\A#{1,3} ")
    return F.when(glued, F.substring(notes, F.length(before) + 1, F.length(notes))).otherwise(notes)


def _summary_under(pieces: Column, words: str) -> Column:
    """Content of the last heading (levels 1-4) naming one of ``words`` that has any; sub-headings belong to it."""
    pattern = rf"(?iU)\A#{{1,4}}\s+.*(?:{words})"
    hits = F.array_compact(F.transform(pieces, lambda p, i: F.when(
        (p["level"] > 0) & p["line"].rlike(pattern), F.struct(i.alias("at"), p["level"].alias("level")))))

    def content(hit):
        later = F.slice(pieces, hit["at"] + 2, F.size(pieces))
        stop = lambda r: F.array_position(F.transform(r, lambda p: p["level"] <= hit["level"]), True)
        own = F.element_at(pieces, (hit["at"] + 1).cast("int"))["body"]
        inner = let(later, lambda r: let(stop(r), lambda k: F.when(k == 0, r).otherwise(
            F.slice(r, F.lit(1), F.greatest(k.cast("int") - 1, F.lit(0))))))
        return strip(F.array_join(F.concat(F.array(own), F.transform(inner, lambda p: p["piece"])), "\n"))
    return F.try_element_at(F.filter(F.transform(hits, content), lambda c: c != ""), F.lit(-1))


def notes_summary(notes: Column) -> Column:
    """The notes' own summary section, else their strength section, else their first 700 characters."""
    def piece(p):
        line = _first_line(p)
        hashes = F.length(F.regexp_extract(line, r"(?U)\A(#{1,4})\s", 1))
        return F.struct(hashes.alias("level"), line.alias("line"), _after_first_line(p).alias("body"), p.alias("piece"))
    pieces = F.transform(F.split(unix_lines(notes), "(?U)\n(?=#{1,4}[^\\S\n])"), piece)
    found = let(pieces, lambda p: F.coalesce(*[_summary_under(p, words) for words in fv.SUMMARY_HEADINGS]))
    bare = strip(F.regexp_replace(notes, r"(?mdU)^#+\s.*$", ""))
    cut = F.when(F.length(bare) > fv.SUMMARY_CHARS, F.concat(F.left(bare, F.lit(fv.SUMMARY_CHARS)), F.lit("…"))).otherwise(bare)
    return F.coalesce(found, cut)


def _scope(md: Column, label: str) -> Column:
    return strip(F.regexp_extract(md, rf"(?dU)\*\*{label}:\*\*\s*(.*)", 1))


def report_scope_fields(md: Column, default_date: Column | None = None) -> dict[str, Column]:
    """Columns read from a report's scope list."""
    url, date = _scope(md, "URL audited"), _scope(md, "Date")
    rivals = F.filter(F.transform(F.split(_scope(md, "Competitors compared"), ","), strip),
                      lambda x: (x != "") & (x != "none"))
    today = default_date if default_date is not None else F.current_date().cast("string")
    return {
        "url": url,
        "icp": _scope(md, "ICP lens"),
        "competitors": rivals,
        "company": F.when(url != "", company_name(url)).otherwise("company"),
        "date": F.when(date != "", date).otherwise(today),
        "keywords": F.filter(F.split(_scope(md, "High-intent keywords used"), "; "), lambda k: k != ""),
    }


def report_slices(md: Column) -> dict[str, Column]:
    """Body, analyst notes, layer notes, sources and fetch log cut out of a saved report."""
    start = find(md, "## 2.")
    whole_body = F.when(start >= 0, py_slice(md, start, find(md, "\n---\n\n## Appendix A"))).otherwise("")
    at = F.locate(fv.FIELD_NOTES_HEADING, whole_body)
    body = F.when(at > 0, F.left(whole_body, at - 1)).otherwise(whole_body)
    field_notes = F.when(at > 0, F.substring(whole_body, at + len(fv.FIELD_NOTES_HEADING), F.length(whole_body)))
    analyst = _last_per_layer(F.transform(
        F.filter(md_sections(field_notes, 3), lambda s: s["heading"] != ""),
        lambda s: F.struct(layer_number(s["heading"], F.lit(1)).alias("layer"), s["content"].alias("text"))))
    log = py_slice(md, find(md, "## Appendix A"), find(md, "## Appendix B"))
    return {
        "body": strip(body),
        "analyst_notes": F.coalesce(analyst, F.array().cast("array<struct<layer:int,text:string>>")),
        "notes": F.transform(_last_pairs(
            md, r"(?sd)<details>\n<summary>(.*?)</summary>\n\n(.*?)\n\n</details>", key=1, value=2),
            lambda p: F.struct(p["key"].alias("title"), notes_clean(p["value"]).alias("text"))),
        "sources": F.transform(_last_pairs(md, r"(?md)^- \[(.*?)\]\((https?://[^)]+)\)$", key=2, value=1),
                               lambda p: F.struct(p["key"].alias("url"), p["value"].alias("title"))),
        "fetch_log": F.regexp_extract_all(log, F.lit("(?md)^- (.*)$"), F.lit(1)),
    }


def _last_pairs(md: Column, pattern: str, key: int, value: int) -> Column:
    """(key, value) groups of every match; a later equal key replaces the value at the first position."""
    pairs = F.zip_with(F.regexp_extract_all(md, F.lit(pattern), F.lit(key)),
                       F.regexp_extract_all(md, F.lit(pattern), F.lit(value)),
                       lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return last_by_key(pairs, lambda p: p["key"])


def loaded_layer_status(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    failed = (text == "") | F.contains(F.left(text, F.lit(200)), F.lit(fv.NOT_COMPLETED)) | (strip(text) == fv.NOT_RUN)
    return F.when(failed, "failed").otherwise("done")


def load_reports(reports: DataFrame, default_date: Column | None = None) -> DataFrame:
    """Saved reports as audits: scope fields, slices and the state of each layer."""
    md = F.col("markdown")
    loaded = reports.withColumns(report_scope_fields(md, default_date)).withColumns(report_slices(md))
    layers = F.transform(F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(t).alias("title"))
                                   for i, t in enumerate(fv.LAYER_TITLES, 1)]), lambda x: F.struct(
        x["layer"], x["title"],
        F.coalesce(F.try_element_at(F.filter("notes", lambda n: n["title"] == x["title"]), F.lit(-1))["text"],
                   F.lit("")).alias("notes")))
    return loaded.withColumn("layers", F.transform(layers, lambda x: F.struct(
        x["layer"], x["title"], loaded_layer_status(x["notes"]).alias("status"), x["notes"],
        notes_summary(x["notes"]).alias("summary"))))


def findings_inject(body: Column, findings: Column) -> Column:
    """Puts each finding's bullet first under its layer heading in section 3, else in a section of its own.

    ``findings`` is ``array<struct<layer,observed,why,hypothesis>>``; with none the body is unchanged.
    """
    def first_line_like(rows, pattern, start, end):
        """Zero-based position of the first fitting line in [start, end), or null."""
        fits = F.transform(rows, lambda x, i: x.rlike(pattern) & (i >= start) & (i < end))
        return F.nullif(F.array_position(fits, True), F.lit(0)).cast("int") - 1

    def insert(rows, layer, bullet):
        n = F.size(rows)
        section = first_line_like(rows, r"(?U)\A##\s+3\.|\A##\s+.*Channel-by-Channel", F.lit(0), n)
        return let(section, lambda s: let(
            F.coalesce(first_line_like(rows, r"\A## ", s + 1, n), n), lambda end: let(
                first_line_like(rows, rf"(?U)\A###\s+.*Layer\s*{layer}\b", s + 1, end), lambda head: let(
                    head + 1 + F.when(is_blank(F.coalesce(F.try_element_at(rows, head + 2), F.lit("x"))), 1).otherwise(0),
                    lambda at: F.when(at.isNotNull(), F.concat(
                        F.slice(rows, F.lit(1), F.coalesce(at, F.lit(0))), F.array(bullet),
                        F.slice(rows, F.coalesce(at, F.lit(0)) + 1, n)))))))

    def finding_of(layer):
        return F.try_element_at(F.filter(findings, lambda x: x["layer"] == layer), F.lit(1))

    def place(rows, layer, bullet):
        return let(rows, lambda r: let(insert(r, layer, bullet), lambda done: F.struct(
            F.coalesce(done, r).alias("rows"), (done.isNull() & bullet.isNotNull()).alias("leftover"))))

    rows, left = lines(body), F.lit("")
    for layer in (1, 3):
        f = finding_of(layer)
        bullet = fill(fv.JS_BULLET, observed=f["observed"], why=f["why"], hypothesis=f["hypothesis"])
        placed = place(rows, layer, F.when(f.isNotNull(), bullet))
        section = F.concat(F.lit(f"\n### {fv.LAYER_TITLES[layer - 1]}\n\n"), bullet, F.lit("\n"))
        left = F.concat(left, F.when(placed["leftover"], section).otherwise(""))
        rows = placed["rows"]
    text = F.array_join(rows, "\n")
    with_left = F.when(left != "", F.concat(
        F.regexp_replace(text, rf"(?U){fv.PY_SPACE_CLASS}+\z", ""), F.lit("\n\n## Automated Findings\n"), left)).otherwise(text)
    return F.when(F.size(findings) > 0, F.concat(with_left, F.lit("\n"))).otherwise(body)
