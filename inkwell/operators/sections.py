"""Sections of the digest as Markdown, each a column expression over the day's row: nothing is looked up here, and what is missing says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import paragraphs
from inkwell.functions.urls import label
from inkwell.functions.urls import site as host_of
from inkwell.operators import series

# The texts that a digest shows, and the pages that it refers to.
MISSING = "*Unavailable today: {}. See the run check above.*"
WEATHER_PAGE = "https://open-meteo.com/"
LINE_PAGE = "https://tfl.gov.uk/tube-dlr-overground/status/"
RAIL_PAGE = "https://www.nationalrail.co.uk/status-and-disruptions/"
INDICATOR_PAGE = "https://data.worldbank.org/indicator/"
DATAMAPPER_PAGE = "https://www.imf.org/external/datamapper/{}@WEO/GBR/JAM"
NAMES = {"weather": "Weather in Croydon", "trains": "Trains", "flag": "Flag of the Day", "research": "Research Fact", "ai": "AI Engineering", "scripture": "Sunday Reading", "uk_vs_jamaica": "UK vs Jamaica", "break": "Break day"}
NOT_ALL_NOTICES = "*Some TfL notices could not be shown; check the TfL status page.*"
NO_NOTICE = "No planned disruption listed by TfL."
SEARCHED = "*From an AI web search; may be incomplete or wrong. Check before travelling.*"
NONE_FOUND = "*An AI web search found no notice of planned Thameslink disruption for {}. This is not a guarantee; check before travelling.*"
NO_FLAG = "*Flag image unavailable today.*"
NO_COMPARISON = "*UK comparison unavailable today.*"
REVIEWER = "> **AI reviewer note:** {} Reviewer's source: [{}]({}). The text above follows its cited source; this note is the AI reviewer's own view and may be wrong."
BREAK = "> **Break day — {}.** No study today. Back on {}."
CHECK, UNCHECKED = "> **Run check — warning:** ", "Run check unavailable; raw diagnostics below."
DISAGREES = "AI reviewer disagrees with a sourced claim in: "
NO_DETAILS, SEE_BELOW = "the reviewer flagged a problem but gave no details.", "see diagnostics below."
WIDER = " (a wider search of official statistics sites)"
WORDS_PER_MINUTE = 200
LINE_HEADING, OTHER_HEADING = "### Windrush line (London Overground)", "### Thameslink"
LINE_SOURCE, RAIL_SOURCE = f"Source: [TfL line status]({LINE_PAGE})", f"Check: [National Rail status and disruptions]({RAIL_PAGE})"
NO_STATUS, NO_SEARCH = "the Windrush line status", "the Thameslink check"
AREAS = ("COUNTRY: {}", "LAND AREA: {} ({})", "UK LAND AREA: {} ({})", "SIZE RATIO: {}", "RELATION: {}")
ESTIMATE, COUNTS, BY_SEARCH = ", may be an IMF estimate", "; it counts: ", "found by an AI web search of {} ({})"
LEFT_OUT = "*{} {} {} left out of this translation: the best manuscripts do not have {}.*"
COMPILED, FIRST_READING, LAST_READING, NEXT_READING = "*Outline compiled from Wikipedia.*", "This is the first Sunday reading.", "Previous reading ({}): {}.", "Next reading ({}): {}{}."


def filled(template: str, *values: Column | str) -> Column:
    """The template with its {} replaced by the values in order; null where one is null."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value if isinstance(value, Column) else F.lit(value), F.lit(piece)]
    return F.concat(*parts)


def stacked(*parts: Column | str | None, joint: str = "\n\n") -> Column:
    """Parts apart by an empty line; null ones are left out."""
    return F.array_join(F.array_compact(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])), joint)


def missing(what: Column | str) -> Column:
    return filled(MISSING, what)


def is_missing(section: Column) -> Column:
    return F.contains(section, F.lit(MISSING.split(":")[0] + ":"))


def some(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(F.trim(text) != "", text)


def linked(url: Column) -> Column:
    return filled("[{}]({})", label(url), url)


def section_name(key: Column) -> Column:
    """The name that a section goes by in the run check; null for one that has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), key)


def bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def day_text(date: Column, year: bool = False) -> Column:
    return F.concat(F.date_format(date, "EEEE d MMMM"), F.date_format(date, " yyyy") if year else F.lit(""))


# weather


def parts_text(parts: Column) -> Column:
    return F.concat(F.lit("in the "), F.array_join(parts, " and "))


def _certainty(spell: Column) -> Column:
    return F.when(spell["likely"], "likely").otherwise("possible")


def weather_block(day: Column, clock) -> Column:
    """The weather writer's input. day: sky, feel, high, low, sunrise, sunset and spells (start, end, kind, intensity, likely, peak_chance, parts); clock: a moment as text."""
    spells = day["spells"]
    lines = F.transform(spells, lambda p: F.concat(F.lit("- "), p["intensity"], F.lit(" "), p["kind"], F.lit(", "), _certainty(p), F.lit(", "), parts_text(p["parts"]), F.lit(", from "), clock(p["start"]), F.lit(" to "), clock(p["end"]), F.lit(", peak chance "), p["peak_chance"].cast("string"), F.lit("%")))
    twice = lambda part: F.size(F.filter(spells, lambda p: F.array_contains(p["parts"], part))) >= 2
    often = F.filter(F.array_distinct(F.flatten(F.transform(spells, lambda p: p["parts"]))), twice)
    # in the order of the day
    order = F.array(*[F.lit(p) for p in ("early morning", "morning", "afternoon", "evening", "late evening")])
    often = F.filter(order, lambda p: F.array_contains(often, p))
    rain = F.when(F.size(spells) > 0, F.concat(F.lit("RAIN SPELLS:\n"), F.array_join(lines, "\n"))).otherwise("RAIN SPELLS: none (rain is unlikely all day)")
    return stacked(
        F.concat(F.lit("SKY (07:00 to 19:00): "), day["sky"]),
        F.concat(F.lit("FEELS: "), day["feel"]),
        F.concat(F.lit("HIGH: "), day["high"]),
        F.concat(F.lit("LOW: "), day["low"]),
        rain,
        F.when(F.size(often) > 0, F.concat(F.lit("ON AND OFF: "), F.array_join(often, ", "))),
        F.when(is_heavy(spells), "HEAVY: yes"),
        F.concat(F.lit("SUNRISE: "), day["sunrise"]),
        F.concat(F.lit("SUNSET: "), day["sunset"]),
        joint="\n",
    )


def is_heavy(spells: Column) -> Column:
    return F.exists(spells, lambda p: p["intensity"] == "heavy")


def weather_sentence(day: Column) -> Column:
    """The line for a day whose writer has failed."""
    spells = F.transform(day["spells"], lambda p: F.concat_ws(" ", p["intensity"], p["kind"], _certainty(p), parts_text(p["parts"])))
    rain = F.when(F.size(spells) > 0, F.concat(F.lit("with "), F.array_join(spells, " and "))).otherwise("and rain is unlikely")
    sky = F.concat(F.upper(F.left(day["sky"], F.lit(1))), F.lower(F.substr(day["sky"], F.lit(2))))
    return F.concat(sky, F.lit(" and "), day["feel"], F.lit(", "), rain, F.lit(". A high of "), day["high"], F.lit("."))


def weather_section(day: Column, text: Column, place: str = "Croydon") -> Column:
    """A day without a forecast is null."""
    body = F.coalesce(some(text), weather_sentence(day))
    return stacked(f"## Weather in {place}", F.when(day.isNull(), missing(f"the {place} weather forecast")).otherwise(stacked(body, f"Source: [Open-Meteo]({WEATHER_PAGE})")))


# trains


def trains_section(date: Column, status: Column, search: Column) -> Column:
    """status: struct(notices, dropped), null where the operator's page failed; search: struct(status, summary, urls), null where it failed."""
    listed = stacked(bullets(status["notices"]), F.when(status["dropped"] > 0, NOT_ALL_NOTICES).when(F.size(status["notices"]) == 0, NO_NOTICE))
    found = stacked(paragraphs(search["summary"]), SEARCHED, "Sources:", bullets(F.transform(search["urls"], linked)))
    other = F.when(search.isNull(), missing(NO_SEARCH)).when(search["status"] == "disruption", found).otherwise(filled(NONE_FOUND, day_text(date)))
    return stacked("## Trains", LINE_HEADING, F.when(status.isNull(), missing(NO_STATUS)).otherwise(listed), LINE_SOURCE, OTHER_HEADING, other, RAIL_SOURCE)


# countries


def indicator_page(code: Column | str, cca2: Column) -> Column:
    return F.concat(F.lit(INDICATOR_PAGE), code if isinstance(code, Column) else F.lit(code), F.lit("?locations="), cca2)


def source_page(source: Column, code: Column, cca2: Column, page: Column) -> Column:
    """The page a reader may look a figure up on, by its source."""
    return F.when(source == "worldbank", indicator_page(code, cca2)).when(source == "imf", filled(DATAMAPPER_PAGE, code)).otherwise(page)


def flag_section(country: Column, flag: Column, population: Column, land: Column, comparison: Column, blurb: Column, page: Column, home: str = "GBR") -> Column:
    """country: name, region, subregion, capital, currencies, cca2, cca3; population and land: value, home, year, null where there are none."""
    listed = lambda xs: F.coalesce(some(F.array_join(xs, ", ")), F.lit("—"))
    region = F.coalesce(some(F.concat_ws(" · ", some(country["region"]), some(country["subregion"]))), F.lit("—"))
    dated = lambda text, x: filled("{} ({})", text, x["year"].cast("string"))
    is_home = country["cca3"] == home
    people = F.coalesce(dated(series.format_value(population["value"], F.lit("number")), population), F.lit("unavailable today"))
    versus = F.when(population.isNull(), "unavailable today").when(is_home, "— (this is the UK)").otherwise(dated(series.compare_to_home(population["value"], population["home"]), population))
    area = F.coalesce(dated(series.format_value(land["value"], F.lit("area")), land), F.lit("unavailable today"))
    table = stacked(filled("| Country | {} |", country["name"]), "|---|---|", filled("| Region | {} |", region), filled("| Capital | {} |", listed(country["capital"])), filled("| Currency | {} |", listed(country["currencies"])), filled("| Population | {} |", people), filled("| vs UK | {} |", versus), filled("| Land area | {} |", area), joint="\n")
    told = some(blurb).isNotNull() & page.isNotNull()
    sources = F.array_compact(F.array(F.when(told, filled("[Wikipedia]({})", page)), F.when(population.isNotNull(), filled("[World Bank population]({})", indicator_page("SP.POP.TOTL", country["cca2"]))), F.when(land.isNotNull(), filled("[World Bank land area]({})", indicator_page("AG.LND.TOTL.K2", country["cca2"])))))
    return stacked(
        filled("## Flag of the Day: {}", country["name"]),
        F.coalesce(filled("![Flag of {}]({})", country["name"], some(flag)), F.lit(NO_FLAG)),
        table,
        F.when(land.isNotNull() & ~is_home, F.coalesce(filled("**Size vs UK:** {}", some(comparison)), F.lit(NO_COMPARISON))),
        F.when(told, paragraphs(blurb)).otherwise(missing("the country description")),
        F.when(F.size(sources) > 0, F.concat(F.lit("Sources: "), F.array_join(sources, " · "))),
    )


def land_block(name: Column, land: Column) -> Column:
    """struct(block, relation): the input of the writer who compares areas."""
    relation = series.land_relation(land["value"], land["home"])
    year = land["year"].cast("string")
    block = stacked(filled(AREAS[0], name), filled(AREAS[1], series.format_value(land["value"], F.lit("area")), year), filled(AREAS[2], series.format_value(land["home"], F.lit("area")), year), filled(AREAS[3], series.compare_to_home(land["value"], land["home"])), filled(AREAS[4], relation), joint="\n")
    return F.struct(block.alias("block"), relation.alias("relation"))


# a fact of two countries; each figure: value, year, via, estimate, unit_note, url, org, tier


def fact_cell(entry: Column, figure: Column) -> Column:
    unit = F.coalesce(F.concat(F.lit(" "), some(entry["unit"])), F.lit(""))
    year = figure["year"].cast("string")
    return F.when(figure.isNull(), "not available today").when(entry["format"] == "year", year).otherwise(F.concat(series.format_value(figure["value"], entry["format"]), unit, F.lit(" ("), year, F.lit(")")))


def fact_how(entry: Column, figure: Column, with_notes: bool = True) -> Column:
    estimate = F.when(figure["estimate"], ESTIMATE).otherwise("")
    counts = F.coalesce(F.concat(F.lit(COUNTS), some(figure["unit_note"])), F.lit("")) if with_notes else F.lit("")
    searched = F.concat(filled(BY_SEARCH, host_of(figure["url"]), figure["org"]), estimate, counts)
    return F.when(figure["via"] == "search", searched).otherwise(F.concat(entry["org"], F.lit(" data"), estimate))


def fact_verdict(entry: Column, home: Column, other: Column) -> Column:
    tier = F.greatest(F.coalesce(home["tier"], F.lit(0)), F.coalesce(other["tier"], F.lit(0)))
    found = series.comparability(home["value"], other["value"], entry["format"], entry["harmonised"], tier)
    own = (~F.coalesce(entry["harmonised"], F.lit(False))) & home.isNotNull() & other.isNotNull() & (entry["format"] != "year")
    return F.struct(found["compared"].alias("compared"), F.when(own, F.coalesce(some(entry["not_compared_because"]), found["reason"])).otherwise(found["reason"]).alias("reason"))


def fact_relation(entry: Column, home: Column, other: Column) -> Column:
    """The relation as text, '' where the figures are not compared."""
    return F.coalesce(F.when(fact_verdict(entry, home, other)["compared"], series.gap(other["value"], home["value"], entry["format"])), F.lit(""))


def fact_block(entry: Column, home: Column, other: Column, with_notes: bool = True) -> Column:
    """The fact writer's input; without notes it is what a paragraph's quantities are held against."""
    verdict, relation = fact_verdict(entry, home, other), fact_relation(entry, home, other)
    line = lambda name, x: F.concat(F.lit(f"{name}: "), fact_cell(entry, x), F.when(x.isNotNull(), F.concat(F.lit(" ("), fact_how(entry, x, with_notes), F.lit(")"))).otherwise(""))
    apart = (home["year"] != other["year"]) & (entry["format"] != "year")
    return stacked(
        filled("FACT: {}", entry["label"]),
        filled("MEANING: {}", entry["meaning"]),
        line("UK", home),
        line("JAMAICA", other),
        F.when(verdict["compared"], filled("RELATION: {}", relation)).when(verdict["reason"] != "", filled("COMPARABILITY: not compared: {}", verdict["reason"])),
        F.when(apart, filled("NOTE: the figures are from different years (Jamaica {}, UK {})", other["year"].cast("string"), home["year"].cast("string"))),
        joint="\n",
    )


def fact_sentence(entry: Column, home: Column, other: Column) -> Column:
    """The paragraph of a fact whose writer has failed."""
    relation = fact_relation(entry, home, other)
    return F.concat(filled("{} The UK's figure is {} and Jamaica's is {}.", entry["meaning"], fact_cell(entry, home), fact_cell(entry, other)), F.when(relation != "", filled(" Jamaica's figure is {}.", relation)).otherwise(""))


def search_note(entry: Column, home: Column, other: Column) -> Column:
    """The notice for figures that a web search has found; null where it has found none."""
    by_search = lambda x: F.coalesce(x["via"] == "search", F.lit(False))
    where = lambda x: F.when(by_search(x), F.concat(host_of(x["url"]), F.when(x["tier"] == 2, WIDER).otherwise("")))
    sites = F.array_join(F.array_distinct(F.array_compact(F.array(where(home), where(other)))), " / ")
    both = by_search(home) & by_search(other)
    only = entry["source"] == "search"
    who = F.when(both & only, "These figures were").when(both, "Both figures were").when(by_search(home), "The UK's figure was").otherwise("Jamaica's figure was")
    rest = F.when(only, filled("web search of {}; no data API covers this fact.", sites)).otherwise(filled("web search fallback of {}, not from a data API.", sites))
    return F.when(by_search(home) | by_search(other), F.concat(F.lit("> **Note:** "), who, F.lit(" found by an AI (LLM) "), rest))


def comparison_section(entry: Column, home: Column, other: Column, text: Column) -> Column:
    """Both figures in a table, the paragraph, the notice on searched figures and each figure's source; two figures of one page share a link."""
    reason = fact_verdict(entry, home, other)["reason"]
    head = stacked("| | UK | Jamaica |", "|---|---|---|", filled("| {} | {} | {} |", entry["label"], fact_cell(entry, home), fact_cell(entry, other)), joint="\n")
    note = lambda name, x: filled(name + ": {}.", F.regexp_replace(some(x["unit_note"]), r"\.+$", ""))
    counts = F.concat_ws(" ", note("UK", home), note("Jamaica", other))
    name = lambda x: F.when(x["via"] == "api", filled("{} — {}", entry["org"], entry["code"])).otherwise(x["org"])
    link = lambda x, who: filled("[{}{}]({})", name(x), who, x["url"])
    shared = F.coalesce(home["url"] == other["url"], F.lit(False))
    sources = F.when(shared, link(home, "")).otherwise(F.concat_ws(" · ", link(home, " (UK)"), link(other, " (Jamaica)")))
    whole = stacked(filled("### {}", entry["label"]), head, F.when(reason != "", filled("*Not compared: {}.*", reason)), F.when(counts != "", filled("**What the figures count:** {}", counts)), F.coalesce(some(text), fact_sentence(entry, home, other)), search_note(entry, home, other), F.concat(F.lit("Sources: "), sources))
    return stacked("## UK vs Jamaica", F.when(home.isNull() & other.isNull(), missing("the UK vs Jamaica fact")).otherwise(whole))


def figures_by_tier(wanted: DataFrame, tiers: list[DataFrame], by: list[str]) -> DataFrame:
    """``wanted`` (by) with the figure of the first of ``tiers`` (by, figure) that has one, its number, from 0, and what earlier tiers lacked.

    Each tier is asked only for what those before it have not got.
    """
    left, found = wanted.select(*by), None
    for k, tier in enumerate(tiers):
        got = left.join(tier.select(*by, "figure"), by).withColumn("tier", F.lit(k))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(*by), by, "left_anti")
    missed = left.withColumn("figure", F.lit(None).cast(dict(found.dtypes)["figure"])).withColumn("tier", F.lit(None).cast("int"))
    return found.unionByName(missed)


# texts


def research_section(topic: Column, headline: Column, body: Column, title: Column, url: Column) -> Column:
    whole = stacked(filled("## Research Fact: {}", headline), paragraphs(body), filled("Source: [{} — Wikipedia]({})", title, url))
    good = some(headline).isNotNull() & some(body).isNotNull() & url.isNotNull()
    return F.when(good, whole).otherwise(stacked(filled("## Research Fact: {}", topic), missing("the research fact")))


def engineering_section(theme: Column, lesson: Column) -> Column:
    """lesson: title, concept, why, urls; null where there is none."""
    named = filled("*Theme: {}*", theme)
    whole = stacked(filled("## AI Engineering: {}", lesson["title"]), named, "### Concept", paragraphs(lesson["concept"]), "### Why it matters", bullets(lesson["why"]), "### Sources", bullets(F.transform(lesson["urls"], linked)))
    return F.when(lesson.isNull(), stacked("## AI Engineering", named, missing("the AI Engineering topic"))).otherwise(whole)


def outline(parts: Column, chapter_range) -> Column:
    """A flowchart of a book's outline (first, last, label), a node a part in their order."""
    nodes = F.transform(parts, lambda p, i: F.concat(F.lit("    s"), i.cast("string"), F.lit('["'), chapter_range(p["first"], p["last"]), F.lit(": "), p["label"], F.lit('"]')))
    steps = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.concat(F.lit("    s"), i.cast("string"), F.lit(" --> s"), (i + 1).cast("string"))))
    return stacked("```mermaid", "flowchart TD", F.array_join(nodes, "\n"), F.array_join(steps, "\n"), "```", joint="\n")


def outline_label(parts: Column, chapters: Column) -> Column:
    """The labels of the parts that the chapters fall in, each once, in the order of the chapters."""
    of = lambda c: F.transform(F.filter(parts, lambda p: c.between(p["first"], p["last"])), lambda p: p["label"])
    return F.array_join(F.array_distinct(F.flatten(F.transform(chapters, of))), "; ")


def chapter_text(book: Column, number: Column, heading: Column, verses: Column, omitted: Column) -> Column:
    """A chapter: a paragraph per verse (v, lines) with hard breaks between its lines, and a word on verses that are left out."""
    verse = lambda v: F.concat(F.lit("**"), v["v"], F.lit("** "), F.array_join(v["lines"], "  \n"))
    names = F.transform(omitted, lambda o: F.replace(o, F.lit("-"), F.lit("–")))
    many = (F.size(names) > 1) | F.contains(F.get(names, F.lit(0)), F.lit("–"))
    listed = F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(filled("{} and {}", F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), ", "), F.element_at(names, -1)))
    word = lambda plural, single: F.when(many, plural).otherwise(single)
    left_out = F.when(F.size(names) > 0, filled(LEFT_OUT, word("Verses", "Verse"), listed, word("are", "is"), word("them", "it")))
    return stacked(filled("### {} {}", book, number.cast("string")), filled("*{}*", some(heading)), F.array_join(F.transform(verses, verse), "\n\n"), left_out)


def reading_minutes(words: Column) -> Column:
    return F.bround(words / WORDS_PER_MINUTE).cast("int")


def reading_section(reading: Column) -> Column:
    """A Sunday reading: title, translation, licence, url, overview (authorship, about, outline, plan, prologue; null but in a book's first week), book,
    previous (title, date, overview; null on the first Sunday), recap, chapters (texts), next (title, date, overview, part), wiki (title, url)."""
    overview, previous, upcoming = reading["overview"], reading["previous"], reading["next"]
    told = F.when(some(overview["about"]).isNotNull(), stacked("### Who wrote it", paragraphs(overview["authorship"]), "### What it's about", paragraphs(overview["about"]))).otherwise(missing(filled("the overview of {}", reading["book"])))
    first = F.when(overview.isNotNull(), stacked(told, "### Structure", overview["outline"], COMPILED, "### Reading plan", bullets(overview["plan"]), filled("### The Prologue\n\n{}", some(overview["prologue"]))))
    about = lambda x: F.when(x["overview"], filled("an overview of {}", x["title"])).otherwise(x["title"])
    back = F.when(previous.isNull(), FIRST_READING).otherwise(stacked(filled(LAST_READING, day_text(previous["date"]), about(previous)), F.when(~previous["overview"], paragraphs(some(reading["recap"])))))
    part = F.when(~upcoming["overview"], filled(" (part of: {})", upcoming["part"])).otherwise("")
    sources = F.array_compact(F.array(filled("[{} — eBible.org]({})", reading["translation"], reading["url"]), filled("[{} — Wikipedia]({})", reading["wiki"]["title"], reading["wiki"]["url"])))
    return stacked(
        filled("## Sunday Reading: {}", reading["title"]),
        filled("*{} ({})*", reading["translation"], F.lower(reading["licence"])),
        first,
        "### Look back",
        back,
        F.when(F.size(reading["chapters"]) > 0, F.array_join(reading["chapters"], "\n\n")),
        "### Look forward",
        filled(NEXT_READING, day_text(upcoming["date"]), about(upcoming), part),
        F.concat(F.when(F.size(sources) > 1, "Sources: ").otherwise("Source: "), F.array_join(sources, " · ")),
    )


def break_section(name: Column, back: Column) -> Column:
    return filled(BREAK, name, day_text(back))


def stewards_section(team: Column, names: Column, mine: Column, note: Column, lacking: Column, reminder: Column) -> Column:
    on_duty = filled("**{} team** ({})", team, names)
    line = F.when(team.isNotNull() & mine, F.concat(on_duty, F.lit(" — **you are on duty today.**"))).when(team.isNotNull(), F.concat(on_duty, F.lit(". You are not on duty."))).when(note.isNotNull(), filled("No team on duty: {}. You are not on duty.", note)).otherwise(filled("> **{}**", lacking))
    return stacked("## Stewards on Duty", line, filled("> **{}**", some(reminder)))


def reviewer_note(note: Column, url: Column) -> Column:
    ended = F.when(note.rlike(r"[.!?]$"), note).otherwise(F.concat(note, F.lit(".")))
    return filled(REVIEWER, ended, label(url), url)


def run_check_box(status: Column, notes: Column, diagnostics: Column, sections: Column) -> Column:
    """The box under the title, '' where all is well. status: null where the review itself has failed; sections: names that the reviewer disagrees with."""
    flagged = F.coalesce(status == "warning", F.lit(False))
    said = F.when(status.isNull() & (F.size(diagnostics) > 0), F.array(F.lit(UNCHECKED))).when(flagged, notes).otherwise(F.array().cast("array<string>"))
    pointer = F.when(F.size(sections) > 0, F.concat(F.lit(DISAGREES), F.array_join(sections, ", "), F.lit(".")))
    headline = F.when(F.size(said) > 0, F.array_join(said, " ")).when(F.size(diagnostics) > 0, SEE_BELOW).otherwise(F.coalesce(pointer, F.lit(NO_DETAILS)))
    well = (F.size(said) == 0) & (F.size(diagnostics) == 0) & pointer.isNull() & ~flagged
    listed = F.when(F.size(diagnostics) > 0, F.concat(F.lit(">\n"), F.array_join(F.transform(diagnostics, lambda d: F.concat(F.lit("> - "), d)), "\n")))
    box = stacked(F.concat(F.lit(CHECK), headline), F.when(pointer.isNotNull() & (headline != pointer), F.concat(F.lit(">\n> "), pointer)), listed, joint="\n")
    return F.when(well, "").otherwise(box)


def documents(days: DataFrame, sections: DataFrame, notes: DataFrame) -> DataFrame:
    """(date, document, noted): a day's document from (date, title, dated, status, review_notes, diagnostics), its sections (date, ord, key, name, text) and the
    reviewer's disagreements (date, section, seq, note, url).

    A disagreement stands behind its section only where that is rendered and available; only those are pointed to in the box.
    """
    said = notes.withColumn("said", reviewer_note(F.col("note"), F.col("url"))).groupBy("date", F.col("section").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda x: x["said"]).alias("said"))
    whole = sections.join(said, ["date", "key"], "left").withColumn("said", F.when(~is_missing(F.col("text")), F.col("said")))
    whole = whole.withColumn("text", F.array_join(F.concat(F.array("text"), F.coalesce("said", F.array().cast("array<string>"))), "\n\n"))
    # a day has some ten sections
    bodies = whole.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ord", "text", F.when(F.col("said").isNotNull(), F.col("name")).alias("noted")))).alias("parts"))
    noted = F.array_compact(F.transform("parts", lambda p: p["noted"]))
    box = some(run_check_box(F.col("status"), F.col("review_notes"), F.col("diagnostics"), noted))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return days.join(bodies, "date").select("date", F.concat(stacked(filled("# {}", F.col("title")), F.col("dated"), box, body), F.lit("\n")).alias("document"), noted.alias("noted"))
