"""Text functions as Column expressions. Six equalities of names and texts are kept apart."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters that library search folds, and the words that a question doesn't search for.
FOLDED = "áàäâéèëêíìïîóòöôúùüûñ"
PLAIN = "aaaaeeeeiiiioooouuuun"
STOP_WORDS = tuple(
    """que qué por para con los las del una uno pero como cómo cuando cuándo donde dónde sobre este esta esto eso ese esa
    esos esas hay han fue ser son the sus más mas muy nos les algo todo toda dijo dice hizo hace puede sido está esta estan están
    what when where which who whom was were did does have has had the and for with from about this that these those there
    they them his her its our your are not any all can could would should said say says into over than then""".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Library search, link keys, assignees: lower case, listed letters folded, other than letters and numbers as one space."""
    plain = F.regexp_replace(F.translate(F.lower(text), FOLDED, PLAIN), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


@F.pandas_udf(T.StringType())
def person_key(names: pd.Series) -> pd.Series:
    """A person in lists: without diacritics, trimmed, lower case; punctuation stays. Spark has no decomposition built in."""
    bare = lambda n: None if n is None else "".join(c for c in unicodedata.normalize("NFD", n) if not unicodedata.combining(c)).strip().lower()
    return names.map(bare)


def ascii_key(text: Column) -> Column:
    """A task's assignee against a speaker: only A-Z and a-z are the same."""
    return F.translate(text, UPPER, LOWER)


def _marked(first: int, last: int) -> tuple[str, str]:
    """Letters of a block whose decomposition begins with an ASCII letter, and those letters, in lower case."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0].lower()) for c in map(chr, range(first, last)) if c.islower() and unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz"]
    return "".join(c for c, _ in pairs if unicodedata.normalize("NFD", c) != c), "".join(p for c, p in pairs if unicodedata.normalize("NFD", c) != c)


#: Every Latin letter with diacritics, and the letter without.
LATIN, BARE = (a + b + c for a, b, c in zip(_marked(0xC0, 0x250), _marked(0x1E00, 0x1F00), ("", ""), strict=True))


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and numbers, lower case, all Latin diacritics removed, combining marks too."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), LATIN, BARE)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(question: Column, least: int = 3, most: int = 24) -> Column:
    """The terms of a question: long enough, no stop words, each once, the first ``most``."""
    words = F.split(F.lower(question), r"[^\p{L}\p{N}]+")
    useful = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(useful), 1, most)


def or_query(question: Column) -> Column:
    """Terms quoted and joined by OR; null if there is none."""
    terms = query_terms(question)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def timestamp(ms: Column) -> Column:
    """MM:SS, from an hour on HH:MM:SS."""
    s = F.floor(ms / 1000).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.concat_ws(":", F.when(h < 10, two(h)).otherwise(h.cast("string")), two(m), two(s % 60))).otherwise(F.concat_ws(":", two(m), two(s % 60)))


def parse_timestamp(text: Column) -> Column:
    """Milliseconds of one to three parts, other characters dropped; null if that isn't a time."""
    parts = F.split(F.regexp_replace(text, "[^0-9:]", ""), ":")
    n = F.transform(parts, lambda p: F.try_to_number(p, F.lit("999999999")).cast("long"))
    total = F.when(F.size(n) == 1, n[0]).when(F.size(n) == 2, F.try_element_at(n, F.lit(1)) * 60 + F.try_element_at(n, F.lit(2))).when(F.size(n) == 3, F.try_element_at(n, F.lit(1)) * 3600 + F.try_element_at(n, F.lit(2)) * 60 + F.try_element_at(n, F.lit(3)))
    return total * 1000


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clamped_title(text: Column, most: int = 60) -> Column:
    """At most ``most`` characters, the last an ellipsis where it is cut: at white space if half of them stay."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    cut = F.left(whole, F.lit(most - 1))
    at_word = F.regexp_extract(cut, r"(?s)^(.*)\s\S*$", 1)
    kept = F.when(F.length(at_word) >= most // 2, at_word).otherwise(cut)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(kept, "[ :-]+$", ""), F.lit("…")))


def truncated(text: Column, most: int, whole: bool = True) -> Column:
    """With an ellipsis after ``most`` characters, or within them if not ``whole``."""
    keep = most if whole else most - 1
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\*_~`|])", r"\\$1")


def bare_word(text: Column) -> Column:
    """Letters and numbers only, lower case: how overlapping and hallucinated words are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def excerpt(text: Column, terms: Column, before: int = 42, after: int = 72) -> Column:
    """(before, matched, after) around the first of the terms that occurs, with ellipses where cut; null without one.

    White space is collapsed on both sides; a space beside the match stays. Folding keeps the length of
    a text, so places in the folded one are places in the original.
    """
    plain = F.translate(F.lower(text), FOLDED, PLAIN)
    hit = F.get(F.filter(terms, lambda t: (t != "") & F.contains(plain, t)), F.lit(0))
    at = F.instr(plain, hit)
    start = F.greatest(at - before, F.lit(1))
    stop = at + F.length(hit)
    left, right = F.substring(text, start, at - start), F.substring(text, stop, F.lit(after))
    spaced = lambda part, edge: F.when(part.rlike(edge) & (collapsed(part) != ""), " ").otherwise("")
    left = F.concat(F.when(start > 1, "…").otherwise(""), collapsed(left), spaced(left, r"\s$"))
    right = F.concat(spaced(right, r"^\s"), collapsed(right), F.when(F.length(text) >= stop + after, "…").otherwise(""))
    return F.when(at > 0, F.struct(left.alias("before"), F.substring(text, at, F.length(hit)).alias("matched"), right.alias("after")))


def first_match(candidates: Column, terms: Column) -> Column:
    """(before, matched, after, source) of the first of ``candidates`` (array of text, source) that has a term, else null."""
    found = F.transform(candidates, lambda c: F.struct(excerpt(c["text"], terms).alias("x"), c["source"].alias("source")))
    first = F.get(F.filter(found, lambda c: c["x"].isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["x"]["before"].alias("before"), first["x"]["matched"].alias("matched"), first["x"]["after"].alias("after"), first["source"].alias("source")))


def percent_decoded(text: Column) -> Column:
    """URL decoding with + as space; a broken escape stays as it is, and the others are decoded."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_parameter(url: Column, name: str, default: str | None = None) -> Column:
    found = F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1)
    return F.coalesce(F.when(found != "", percent_decoded(found)), F.lit(default))


def interpolated(template: Column, values: Column) -> Column:
    """{name} replaced by the value of the entry of that name; unknown names stay, and values aren't looked at again."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))
    named = lambda p: F.try_element_at(values, F.regexp_extract(p, r"^\{(\w+)\}$", 1))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(p.rlike(r"^\{\w+\}$"), named(p)), p)), "")


def usable_name(name: Column, device: Column | None = None) -> Column:
    """A participant's name, collapsed; null for over 100 characters, the device's own id, a device path or a placeholder."""
    n = collapsed(name)
    own = F.lower(F.trim(device)).eqNullSafe(F.lower(n)) if device is not None else F.lit(False)
    path = n.rlike(r"(?i)^(?:spaces/[^/]+/)?devices(?:/[^/]+)?$")
    placeholder = n.rlike(r"(?i)^(?:device|devices|participant|participants|participante|participantes|participante sin identificar|unknown participant)$")
    return F.when((n != "") & (F.length(n) <= 100) & ~own & ~path & ~placeholder, n)


def match_key(name: Column) -> Column:
    """A username as it is typed: trimmed, without @, whatever its case."""
    return F.lower(F.ltrim(F.trim(name), F.lit("@")))


def folder_name(text: Column, most: int = 40) -> Column:
    """Collapsed, at most ``most`` characters; null if nothing is left."""
    clean = F.trim(F.left(collapsed(text), F.lit(most)))
    return F.when(clean != "", clean)


def readable_source(name: Column) -> Column:
    """Null for a name that only numbers a channel or server, as in "canal 1234567"."""
    return F.when(~name.rlike(r"(?i)^\s*(canal|channel|servidor|server)\s+[0-9]{6,}\s*$"), name)


def locale_of(tag: Column) -> Column:
    return F.when(F.startswith(F.lower(tag), F.lit("es")), "es").otherwise("en")


def size_label(size: Column) -> Column:
    """Bytes in MB, from 1e9 on in GB with one digit."""
    whole = F.concat(F.floor(size / 1e6 + 0.5).cast("string"), F.lit(" MB"))
    return F.when(size >= 1_000_000_000, F.concat(F.format_string("%.1f", size / 1e9), F.lit(" GB"))).otherwise(whole)


def length_label(minutes: Column) -> Column:
    """Minutes as "5 min", "2 h" or "2 h 5 min"; empty below one."""
    h, rest = F.floor(minutes / 60), minutes % 60
    return F.when(minutes < 1, "").when(minutes < 60, F.concat(minutes, F.lit(" min"))).when(rest == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), rest, F.lit(" min")))


def file_name(title: Column, started: Column, extension: str) -> Column:
    """When it began and the title's letters and numbers, parted by hyphens; "reunion" for a title without any."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""))
    return F.concat(F.date_format(started, "yyyyMMdd-HHmm"), F.lit("-"), F.when(slug == "", "reunion").otherwise(slug), F.lit(f".{extension}"))


def meeting_of(url: Column, title: Column) -> Column:
    """(platform, id) of a meeting's URL, by host, path or parameter; the title stands in for a missing id."""
    host, path = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    filled = lambda c: F.when(c != "", c)
    meet = F.struct(F.lit("google_meet").alias("platform"), F.coalesce(F.get(segments, F.lit(0)), title).alias("id"))
    zoom = F.struct(F.lit("zoom").alias("platform"), F.coalesce(filled(F.regexp_extract(path, "/(?:wc|j|w)/([^/?#]+)", 1)), title).alias("id"))
    teams = F.struct(F.lit("microsoft_teams").alias("platform"), F.coalesce(filled(query_parameter(url, "meetingId")), F.try_element_at(segments, F.lit(-1)), title).alias("id"))
    return F.when(host == "meet.google.com", meet).when((host == "zoom.us") | host.endswith(".zoom.us"), zoom).otherwise(teams)


#: The sentence that carries a vocabulary, by language (fixed values).
CARRIERS = {"es": "En esta reunión hablamos de {0}.", "en": "In this meeting we talk about {0}."}


def vocabulary_prompt(terms: Column, language: str, chars: int = 80, most: int = 64, total: int = 1024) -> Column:
    """A sentence with the terms, cleaned, each once whatever its case, until one of the limits is reached; null without any."""
    clean = F.filter(F.transform(terms, lambda x: F.left(collapsed(F.translate(x, "\0", " ")), F.lit(chars))), lambda x: x != "")
    cost = lambda out: F.aggregate(out, F.lit(0), lambda n, x: n + F.length(x) + 2)

    def add(out: Column, x: Column) -> Column:
        full = (F.size(out) >= most) | (cost(out) >= total)
        return F.when(full | F.exists(out, lambda o: F.lower(o) == F.lower(x)), out).otherwise(F.array_append(out, x))

    kept = F.array_join(F.aggregate(clean, F.array().cast("array<string>"), add), ", ")
    before, after = CARRIERS.get(language, "{0}.").split("{0}")
    return F.when(kept != "", F.concat(F.lit(before), kept, F.lit(after)))


def markdown_document(title: Column, started: Column, duration_ms: Column, people: Column, overview: Column, decisions: Column, utterances: Column) -> Column:
    """A meeting as Markdown. ``utterances``: array of (start_ms, speaker, text) in order; a null overview means no summary."""
    bullets = F.when(F.size(decisions) > 0, F.concat(F.lit("## Decisiones\n\n"), F.array_join(F.transform(decisions, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))).otherwise("")
    summary = F.when(F.trim(overview) != "", F.concat(F.lit("## Resumen\n\n"), F.trim(overview), F.lit("\n\n"))).otherwise("")
    said = F.array_join(F.transform(utterances, lambda u: F.concat(F.lit("**["), timestamp(u["start_ms"]), F.lit("] "), u["speaker"], F.lit(":** "), F.trim(u["text"]), F.lit("\n\n"))), "")
    return F.concat(
        F.lit("# "), title, F.lit("\n\n**Fecha:** "), F.date_format(started, "yyyy-MM-dd HH:mm"), F.lit(" UTC  \n**Duración:** "), timestamp(duration_ms), F.lit("  \n"),
        F.when(F.size(people) > 0, F.concat(F.lit("**Participantes:** "), F.array_join(people, ", "), F.lit("\n"))).otherwise(""), F.lit("\n"),
        F.when(overview.isNull(), "> Todavía no hay resumen para esta reunión.\n\n").otherwise(F.concat(summary, bullets)),
        F.lit("---\n\n## Transcripción\n\n"), F.when(F.size(utterances) > 0, said).otherwise("_No se transcribió nada._\n"),
    )


def title_of(display: Column, guild: Column, channel: Column) -> Column:
    """The display title as it stands if it isn't blank, else guild and channel."""
    return F.when(F.trim(display) != "", display).otherwise(F.concat_ws(" · ", guild, channel))


#: What a meeting without names is called, by platform (fixed values).
PLATFORMS = ("Google Meet", "Microsoft Teams", "Zoom")


def fallback_title(names: Column, guild: Column, channel: Column) -> Column:
    """A title from the participants' names, blanks dropped, in their order."""
    n = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    at = lambda i: F.get(n, F.lit(i))
    none = F.when(guild.isin(*PLATFORMS), F.concat(F.lit("Reunión de "), guild)).otherwise(F.concat(F.lit("Reunión en #"), channel))
    three = F.concat(at(0), F.lit(", "), at(1), F.lit(" y "))
    return F.when(F.size(n) == 0, none).when(F.size(n) == 1, F.concat(F.lit("Sesión de "), at(0))).when(F.size(n) == 2, F.concat(at(0), F.lit(" y "), at(1))).when(F.size(n) == 3, F.concat(three, at(2))).otherwise(F.concat(three, (F.size(n) - 2).cast("string"), F.lit(" más")))


def without_overlap(previous: Column, text: Column, most: int = 20) -> Column:
    """``text`` without the words that it repeats from the end of ``previous``: the longest run of up to ``most``.

    Words are compared as bare words; a run of one counts only if the word has five characters.
    """
    cut = lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    old, new = cut(F.coalesce(previous, F.lit(""))), cut(text)
    bare = lambda words: F.transform(words, bare_word)
    longest = F.least(F.size(old), F.size(new), F.lit(most))
    runs = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    same = lambda k: (bare(F.slice(old, F.size(old) - k + 1, k)) == bare(F.slice(new, F.lit(1), k))) & ((k >= 2) | (F.length(bare_word(F.get(new, F.lit(0)))) >= 5))
    drop = F.coalesce(F.array_max(F.filter(runs, same)), F.lit(0))
    return F.when(drop > 0, F.array_join(F.slice(new, drop + 1, F.lit(1 << 30)), " ")).otherwise(F.trim(text))


def made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often it is named: else each mention makes it anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_json_object(text: Column) -> Column:
    """The first complete JSON object in a text, by depth of braces outside strings; null if it doesn't end.

    The text is read as strings, braces and what lies between, so the fold is as long as the braces are many.
    """
    return made_once(F.when(F.instr(text, F.lit("{")) > 0, F.substring(text, F.instr(text, F.lit("{")), F.length(text))), _closed)


def _closed(body: Column) -> Column:
    """What starts with a brace, up to the brace that closes it."""
    pieces = F.regexp_extract_all(body, F.lit(r'(?s)"(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("end"))

    def step(at: Column, p: Column) -> Column:
        depth = at["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        read = at["read"] + F.length(p)
        return F.struct(depth.alias("depth"), read.alias("read"), F.coalesce(at["end"], F.when((p == "}") & (depth == 0), read)).alias("end"))

    end = F.aggregate(pieces, start, step, lambda at: at["end"])
    return made_once(end, lambda n: F.when(n.isNotNull(), F.substring(body, F.lit(1), n)))


def allowed_origin(origin: Column) -> Column:
    """An extension's origin: its id has 32 letters from a to p."""
    return origin.rlike("^chrome-extension://[a-p]{32}$")


def searched(rows: DataFrame, haystack: str, question: str) -> DataFrame:
    """Rows whose folded ``haystack`` has every folded term of the question; all rows if it has no term."""
    has = F.forall(F.filter(F.split(folded(F.lit(question)), " "), lambda w: w != ""), lambda w: F.contains(F.col(haystack), w))
    return rows.filter(has)


def of_person(rows: DataFrame, owner: str, people: list[str] | None) -> DataFrame:
    """Rows of the chosen people; "unassigned" stands for no owner, and None for all rows."""
    if people is None:
        return rows
    return rows.filter(F.coalesce(F.when(F.trim(owner) != "", F.col(owner)), F.lit("unassigned")).isin(*people))


def platform_label(slug: Column) -> Column:
    return F.when(slug == "meet", PLATFORMS[0]).when(slug == "teams", PLATFORMS[1]).when(slug == "zoom", PLATFORMS[2]).otherwise("Reunión web")


#: How much more a passage of a kind counts than one of a transcript (fixed values).
KIND_WEIGHTS = {"decision": 1.15, "task": 1.15, "overview": 1.05, "key_point": 1.05, "note": 1.05, "question": 1.05}


def kind_weight(kind: Column) -> Column:
    """The weight of a kind; unknown kinds count as a transcript."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, w in KIND_WEIGHTS.items() for x in (k, w)]), kind), F.lit(1.0))


def summary_of(raw: Column) -> Column:
    """The summary in a model's answer: (title, overview, key_points, decisions, open_questions, action_items, notes).

    Names of fields have aliases; blank entries are dropped, blank values null, times parsed. Null where
    there is no JSON object or nothing usable in it.
    """
    task = "struct<text:string,task:string,description:string,assignee:string,owner:string,due:string,deadline:string,timestamp:string,time:string>"
    note = "struct<text:string,note:string,content:string,author:string,owner:string,speaker:string,timestamp:string,time:string>"
    lists = "keyPoints array<string>, key_points array<string>, decisions array<string>, openQuestions array<string>, open_questions array<string>"
    schema = f"title string, meeting_title string, meetingTitle string, overview string, {lists}, actionItems array<{task}>, action_items array<{task}>, tasks array<{task}>, notes array<{note}>, meeting_notes array<{note}>, meetingNotes array<{note}>"
    # An answer is parsed once, and its lists are made once, though each is named often below.
    parsed = made_once(first_json_object(raw), lambda body: F.when(body.isNotNull(), F.from_json(body, schema)))
    return made_once(parsed, lambda j: made_once(_parts(j), lambda p: _usable(j, p)))


def _parts(j: Column) -> Column:
    """The lists of a parsed answer: (key_points, decisions, open_questions, action_items, notes)."""
    filled = lambda *cs: F.coalesce(*[F.when(~F.lower(F.trim(c)).isin("", "null"), F.trim(c)) for c in cs])
    texts = lambda *cs: F.filter(F.transform(F.coalesce(*cs, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    tasks = F.transform(F.coalesce(j["actionItems"], j["action_items"], j["tasks"], F.array()), lambda x: F.struct(filled(x["text"], x["task"], x["description"]).alias("text"), filled(x["assignee"], x["owner"]).alias("assignee"), filled(x["due"], x["deadline"]).alias("due"), parse_timestamp(F.coalesce(x["timestamp"], x["time"])).alias("source_ms")))
    notes = F.transform(F.coalesce(j["notes"], j["meeting_notes"], j["meetingNotes"], F.array()), lambda x: F.struct(filled(x["text"], x["note"], x["content"]).alias("text"), filled(x["author"], x["owner"], x["speaker"]).alias("author"), parse_timestamp(F.coalesce(x["timestamp"], x["time"])).alias("source_ms")))
    kept = lambda items: F.filter(items, lambda x: x["text"].isNotNull())
    lists = {"key_points": texts(j["keyPoints"], j["key_points"]), "decisions": texts(j["decisions"]), "open_questions": texts(j["openQuestions"], j["open_questions"]), "action_items": kept(tasks), "notes": kept(notes)}
    return F.struct(*[p.alias(n) for n, p in lists.items()])


def _usable(j: Column, parts: Column) -> Column:
    overview = F.coalesce(F.trim(j["overview"]), F.lit(""))
    names = ("key_points", "decisions", "open_questions", "action_items", "notes")
    usable = overview != ""
    for n in names:
        usable = usable | (F.size(parts[n]) > 0)
    title = clamped_title(F.coalesce(j["title"], j["meeting_title"], j["meetingTitle"], F.lit("")))
    return F.when(j.isNotNull() & usable, F.struct(title.alias("title"), overview.alias("overview"), *[parts[n].alias(n) for n in names]))
