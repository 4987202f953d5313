"""Problem 8: sentence boundaries across languages and scripts, in SQL expressions only.

Dots of decimals, URLs, initials and abbreviations, terminators inside quotations and the line breaks of wrapped
paragraphs are masked with private-use placeholders. Boundaries are then set by script-specific terminator
patterns: dots, exclamation and question marks before a start that fits the letter case of the text; full-width
marks without blanks; danda; the Greek question mark; Thai polite particles before a blank. The text is split
there and restored.

A line break ends a sentence, except in wrapped sources (``email_archive``), where only a blank line does. What
opens a line or a sentence (bullet, number, time stamp, speaker, quote, bracket) belongs to its sentence.

Edge cases: null, empty and blank texts have no sentences; pieces without a letter, digit or symbol (stray marks)
make no sentence of their own; a text without any terminator is one sentence a line; texts, quotations and runs of blank
lines of any length are processed whole (only runs of blanks around a terminator are looked at up to four characters); the
private-use characters used as placeholders come out as U+FFFD where a text has them itself; repeated rows come out each
by itself; null source counts as not wrapped; extra columns are ignored. Places are summed up inside the array of a
document's parts, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fenced, spread

WRAPPED = ("email_archive",)

# Placeholders: a masked dot, a line break within a paragraph, straight quotes by direction, a shield after a
# terminator inside a quotation, a boundary, a semicolon that asks in Greek.
DOT, WRAP, OPEN, CLOSE, SHIELD, CUT, ASK = "\ue001", "\ue00b", "\ue00c", "\ue00d", "\ue00e", "\ue00f", "\ue010"
ANY_DOT = rf"[\.{DOT}]"
WS = rf"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff{WRAP}]"
WORD_START = r"(?<![\p{L}\p{M}\p{N}])"

# Abbreviations of the languages of the documents that never end a sentence ...
NEVER = "mr mrs ms messrs dr dra prof capt col gen lt sgt rev st ste mt sr sra srta mme mlle inż inz mgr вул буд кв інж проф просп ul al os pl godz np tj tzw cf vs approx aprox ca bzw env bd avda núm núms nr temp dept ref fig vol αρ κα δηλ डॉ नं श्री".split()
# ... that end none where a number follows;
BEFORE_NUMBER = "p pp s m art model tel jan feb mar apr jun jul aug sep sept oct okt nov dec dez".split()
# nouns after an ordinal number;
ORDINAL_NOUNS = "januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez stock stockwerk etage og obergeschoss".split()
# for texts of one letter case: abbreviations that may end a sentence, prepositions and the like that go on after them,
# firm forms, and conjunctions that go on after dots.
MAY_END = rf"(?:[ap]{DOT}m|p{DOT}s|[πμ]{DOT}μ|etc|usw|hrs|sat|sun|mon|tue|wed|thu|fri|jan|feb|mar|apr|jun|jul|aug|sept?|okt|oct|nov|dec|грн)"
GO_ON = "on or and about at to for in a an of from with until after before as per if when are is was de du del des la le les et ou y o en para por jest na w z od lub на в у і й та з до від або um und oder am im ab bis vom και ή σε στις στη από έως".split()
FIRMS = "inc ltd co corp plc gmbh".split()
GO_ON_DOTS = "then and but or so because puis et mais ou und aber oder dann y pero o luego i ale lub potem і але або потім και αλλά ή".split()
THAI_END = "(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)"

QUOTE_ENDS = f"”»』」“{CLOSE}"
CLOSERS = rf"(?:{WS}?»|[”’“'\)\]』」）】{CLOSE}])*"
NOT_NEXT = rf"[,;:\)\]»”\.!\?…』」）{CLOSE}{SHIELD}]"
GREEK = r"([\u0370-\u03ff\u1f00-\u1fff][^;\n]*);"
END = rf"[\.!\?…।॥؟\u037e{ASK}](?!{SHIELD})"


def _any(words: list[str]) -> str:
    return "|".join(words)


def _before(words: str, then: str) -> str:
    """What follows a dot that these words, in any case, make no end, for ``MASKS``."""
    return rf"(?={then})(?<={WORD_START}(?iu:{words})\.)"


#: Dots that look like an end and are none: what follows the dot, all tried at each dot in one pass.
NO_END = [
    # abbreviations and initials
    _before(_any(NEVER), rf"{WS}|\d"),
    _before(_any(BEFORE_NUMBER), rf"{WS}*[\d№]"),
    rf"(?={WS}*\d)(?<=\p{{L}}(?i:str)\.)",  # a street
    _before("s", rf"{WS}S\."),
    _before(f"i{DOT}e|e{DOT}g|π{DOT}χ", ""),
    _before("z", rf"{WS}?[Bb]\."),
    _before("d", rf"{WS}?[Hh]\."),
    _before("u", rf"{WS}?[Aa]\.{WS}+\p{{L}}"),
    _before("p", rf"{WS}?(?i:ex|ej)\."),
    _before("o", rf"{WS}?[Ää]\."),
    _before("т", rf"{WS}?[ДПдп]\."),
    _before(rf"z{ANY_DOT}{WS}?b|d{ANY_DOT}{WS}?h|p{ANY_DOT}{WS}?e[xj]", ""),
    rf"(?={WS}+[\p{{L}}\d])(?<={WORD_START}\p{{L}}\p{{M}}{{0,2}}\.)(?<!{DOT}\p{{L}}\.)(?<![Тт]{ANY_DOT}{WS}{{0,2}}[ДПдп]\.)",
    # ordinal numbers
    rf"(?={WS}+(?iu:{_any(ORDINAL_NOUNS)})(?!\p{{L}}))(?<=(?<!\d)\d{{1,2}}\.)",
    rf"(?={WS}+\p{{L}})(?<={WORD_START}(?iu:der|die|das|dem|den|des){WS}\d{{1,2}}\.)",
    rf"(?={WS}um{WS})(?<={DOT}\d{{1,2}}\.)",
]

#: pattern, replacement: everything that looks like a boundary and is none.
MASKS = [
    # decimals, versions, URLs, mail addresses: a dot between letters or digits, unless a sentence is glued on
    (r"\.(?=[\p{L}\p{N}])(?<=[\p{L}\p{M}\p{N}]\.)(?!(?<=[\p{Ll}\p{N}]\.)\p{Lu}[\p{Ll}\s\.])", DOT),
    (r"\?(?=[\p{L}\d_]+=)", f"$0{SHIELD}"),
    (rf"\.(?:{_any(NO_END)})", DOT),
    (rf"\.(?={WS}*\p{{L}}{{0,2}}\d)(?<={WORD_START}(?iu:no)\.)(?<![\.!\?…:\]”»{CLOSE}]{WS}{{1,4}}(?i:no)\.)(?<!\n(?i:no)\.)(?<!^(?i:no)\.)", DOT),
    # the number of a list entry
    (r"(?m)^(\s*\d{1,3})\.(?=[ \t])", f"$1{DOT}"),
]

#: Quotations: the mark that opens one, the marks that close it, what may come before it.
QUOTATIONS = [("“", "”", r"(?<![\?!\.,\p{L}])"), ("„", "“”", ""), ("«", "»", ""), ("「", "」", ""), (OPEN, CLOSE, "")]

#: In mixed case a sentence starts with anything but a small letter; small letters go on after a dash, too.
START_CASED = (
    rf"{END}{CLOSERS}{WS}+(?=\p{{Ll}}\p{{Lu}}|(?!\p{{Ll}}|{NOT_NEXT}|[—–\-]{WS}*\p{{Ll}}|{WS})"
    rf"(?!(?<=[{QUOTE_ENDS}]{WS}{{1,4}})\p{{Lo}}))"
)
#: In one case quotations with ! or ? and brackets go on, and so do some words after dots.
START_ONE_CASE = (
    rf"{END}{CLOSERS}{WS}+(?!{NOT_NEXT}|[—–\-]|{WS})"
    rf"(?!(?<=[!\?;؟{ASK}]{WS}?[{QUOTE_ENDS}\)）]{WS}{{1,4}}|[\)）]{WS}{{1,4}})\p{{L}})"
    rf"(?!(?<=(?:\.\.|…){WS}{{1,4}})(?iu:{_any(GO_ON_DOTS)})(?!\p{{L}}))(?!(?<=[{QUOTE_ENDS}]{WS}{{1,4}})\p{{Lo}})(?=\S)"
)
START_GLUED = rf"[!\?\.](?!{SHIELD})(?=\p{{Lu}}[\p{{Ll}}\s{DOT}\.])(?<=[!\?]|[\p{{Ll}}\p{{N}}]\.)"
START_GLUED_ONE_CASE = rf"[!\?](?!{SHIELD})(?=\p{{L}})(?![\p{{L}}\d_]+=)"
START_FULL_WIDTH = rf"[。！？](?!{SHIELD})[）】]*{WS}*(?![。！？…」』”»）】{WS}])(?=\S)"
START_THAI = rf"{THAI_END}{WS}+(?=\S)"


def parted(x: Column, pattern: str, inside: Callable[[Column], Column], outside: Callable[[Column], Column] = lambda y: y) -> Column:
    """The text with its matches of the pattern and what lies between them rewritten, each piece as a whole."""
    between, matches = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, matches, lambda a, b: F.concat(outside(a), F.coalesce(inside(b), F.lit("")))), "")


def masked(text: Column, wrapped: Column) -> Column:
    """The text with masks for everything outside quotations that looks like a boundary and is none."""
    marks = DOT + WRAP + OPEN + CLOSE + SHIELD + CUT + ASK
    x = F.translate(text, marks, "\ufffd" * len(marks))
    # of the line breaks of a wrapped text only blank lines stay
    x = F.when(wrapped, parted(x, r"\n[ \t\r]*\n[ \t\r\n]*", lambda y: y, lambda y: F.translate(y, "\n", WRAP))).otherwise(x)
    x = F.when(x.contains('"'), F.translate(F.regexp_replace(x, rf'(?m)"(?=\S)(?<=^"|[\(\[—–\-:,]"|{WS}")', OPEN), '"', CLOSE)).otherwise(x)
    x = F.when(x.contains(";"), F.regexp_replace(x, GREEK, f"$1{ASK}")).otherwise(x)
    for pattern, to in MASKS:
        x = F.regexp_replace(x, pattern, to)
    return x


def quotations_masked(docs: DataFrame, column: str) -> DataFrame:
    """A shield after each terminator inside a quotation but one right before the closing mark.

    Quotations are parted from the text first, so they may have any length. Each kind takes a projection of its own, as
    the text so far is used more than once, and is tried only on texts that have its marks.
    """
    for opening, closing, before in QUOTATIONS:
        x, stop = F.col(column), opening + closing
        shielded = lambda y: F.regexp_replace(y, rf"[\.!\?…。！？;؟।{ASK}](?!{WS}?[{closing}])", f"$0{SHIELD}")  # noqa: B023, E731
        quoted = x.contains(opening) & F.rlike(x, F.lit(f"[{closing}]"))
        docs = docs.withColumn(column, F.when(quoted, parted(x, rf"{before}{opening}[^{stop}\n]*[{closing}]", shielded)).otherwise(x))
    return docs


def cut(x: Column, text: Column) -> Column:
    """The masked text x with a boundary mark before each new sentence."""
    one_case = (F.lower(text) == text) | (F.upper(text) == text)
    cased = F.regexp_replace(x, START_CASED, f"$0{CUT}")
    y = F.regexp_replace(x, rf"\.(?:{_before(MAY_END, rf'{WS}+(?iu:{_any(GO_ON)})(?!\p{{L}})')}|{_before(_any(FIRMS), rf'{WS}+\p{{L}}')})", DOT)
    y = F.regexp_replace(F.regexp_replace(y, START_ONE_CASE, f"$0{CUT}"), START_GLUED_ONE_CASE, f"$0{CUT}")
    x = F.when(one_case, y).otherwise(cased)
    x = F.regexp_replace(x, START_GLUED, f"$0{CUT}")
    x = F.regexp_replace(x, START_FULL_WIDTH, f"$0{CUT}")
    x = F.when(F.rlike(x, F.lit(r"[\u0e00-\u0e7f]")), F.regexp_replace(x, START_THAI, f"$0{CUT}")).otherwise(x)
    return F.regexp_replace(x, rf"\n{WS}*(?=\S)", f"$0{CUT}")


def restored(text: Column) -> Column:
    """A text without masks but the boundaries."""
    return F.translate(text, DOT + ASK + WRAP + OPEN + CLOSE + SHIELD, '.;\n""')


def sums_before(sizes: Column) -> Column:
    """For each element of an array the sum of those before it, by blocks of about the root of their number."""
    whole = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(sizes, i * n + 1, n))
    totals = F.transform(blocks, whole)
    starts = F.transform(totals, lambda _, i: whole(F.slice(totals, F.lit(1), i)))
    return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b, lambda _, i: at + whole(F.slice(b, F.lit(1), i)))))


def sentences(documents: DataFrame, wrapped_sources: tuple[str, ...] = WRAPPED, with_text: bool = True) -> DataFrame:
    """doc_id, sent_no, start_char (1-based place of the first character that isn't white space) and sentence."""
    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    wrapped = F.coalesce(source.isin(*wrapped_sources), F.lit(False))
    docs = spread(documents.where("text is not null").select("doc_id", "text", "source"))
    docs = quotations_masked(docs.select("doc_id", "text", masked(F.col("text"), wrapped).alias("_masked")), "_masked")
    # fenced: the filter on empty arrays that is inferred for posexplode would be rewritten with all the masks below
    docs = fenced(docs.select("doc_id", F.split(restored(cut(F.col("_masked"), F.col("text"))), CUT).alias("_parts")))
    docs = fenced(docs.select("doc_id", "_parts", F.transform("_parts", F.length).alias("_sizes")))
    docs = fenced(docs.select("doc_id", "_parts", sums_before(F.col("_sizes")).alias("_before")))
    blank = rf"(?s)^{WS}*"
    start = lambda part, before: before + F.length(part) - F.length(F.regexp_replace(part, blank, "")) + 1
    trimmed = (lambda part: F.regexp_replace(part, rf"{blank}|{WS}*$", "")) if with_text else (lambda part: F.lit(None).cast("string"))
    marked = F.zip_with("_parts", "_before", lambda part, before: F.when(F.rlike(part, F.lit(r"[\p{L}\p{N}\p{So}]")), F.struct(start(part, before).alias("start_char"), trimmed(part).alias("sentence"))))
    docs = fenced(docs.select("doc_id", F.array_compact(marked).alias("_found")))
    out = docs.select("doc_id", F.posexplode("_found").alias("_no", "_x"))
    return out.select("doc_id", (F.col("_no") + 1).alias("sent_no"), F.col("_x.start_char").cast("bigint").alias("start_char"), *([F.col("_x.sentence").alias("sentence")] if with_text else []))
