"""Sentence boundaries by cascading tables of break and no-break rules.

A text is first parted into blocks: fenced code, headings, list items, and
paragraphs between blank lines. In a paragraph every run of sentence marks, with
the closing quotes and brackets behind it, is a place where a sentence may end.
Rules are pairs of regular expressions, one for what stands before the place and
one for what stands behind; the first rule whose two sides match decides. The
tables of the languages that a paragraph shows come first, in order, and the
table for all languages last. A cascade is compiled into one expression whose
alternatives are its rules, so a place is decided by one match, and all work on a
paragraph is in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.session import spread

_MARKS = r".!?…。！？।॥؟۔"
_CLOSING = r"(?:\s?»|[)\]}”’\"»」』）】]|“)*"
_PLACE = re.compile(rf"([{_MARKS}]+){_CLOSING}")
#: Signs, references and the like that may stand between two words of a sentence.
_SIGNS = r"(?:(?:\[\d+\]|<\w+>|0x[0-9a-fA-F]+|[^\w\s\"“„«(¿¡「『]+)\s+)*"
_CODE_NAME = r"(?=\w*(?:_|\d|[a-z][A-Z]|::))"
_PLAIN_LOWER = rf"\s+{_SIGNS}(?!{_CODE_NAME})[a-zà-öø-ÿа-яё]"


@dataclass(frozen=True)
class Rule:
    """breaks, if before matches at the end of the marks and after at the start of what follows the closing signs; at_end: before may match those, too."""

    breaks: bool
    before: str
    after: str = ""
    at_end: bool = False


#: The last words of all abbreviations in the tables.
_LAST_WORDS: set[str] = set()


def _words(alternatives: str) -> str:
    """Any of the abbreviations, standing as a word of its own; a blank in one may be any white space or none."""
    _LAST_WORDS.update(re.findall(r"\w+", a)[-1].lower() for a in alternatives.split("|"))
    listed = [r"\s*".join(re.escape(part) for part in a.split(" ")) for a in alternatives.split("|")]
    return rf"(?<![\w.])(?:{'|'.join(listed)})"


@dataclass(frozen=True)
class Language:
    """script: a letter that the language is written with. common: words that show it among languages of one script."""

    script: str
    common: frozenset[str]
    rules: list[Rule]


def _common(words: str) -> frozenset[str]:
    return frozenset(words.split())


_BEFORE_NUMBER = rf"\s+{_SIGNS}[\d#]"
_ALWAYS = r"\s"
#: A clause with a verb of its own starts here, though in a small letter.
_NEW_CLAUSE = r"\s+(?:(?:the|a|an|this|that|these|it|we|they)\b|[a-z]\w*\s+(?:is|are|was|were|has|have)\b)"

# Common words, abbreviations, and names of months, of each language.
LANGUAGES = {
    "en": Language(
        "[A-Za-z]",
        _common("the of and is it to was for on with are that this by be as not when use an at has its which from see we you i or does what who why how if but"),
        [
            Rule(False, _words("e.g.|E.g.|i.e.|I.e.|cf.|Cf.|vs.|approx.|Approx.|esp.|viz.|Mr.|Mrs.|Ms.|Dr.|Prof.|St.|Fig.|fig.|Figs.|Tab.|Eq.|Sec.|sec.|Ch.|ch.|Vol.|vol.|Art.|art.|Ver.|ver.|rev.|Rev.|ca.|max.|min.|avg.|resp.|incl."), _ALWAYS),
            Rule(False, _words("No.|no.|Nos.|nos.|p.|pp.|Jan.|Feb.|Mar.|Apr.|Jun.|Jul.|Aug.|Sep.|Sept.|Oct.|Nov.|Dec."), _BEFORE_NUMBER),
            Rule(True, _words("etc."), _NEW_CLAUSE),
            Rule(False, _words("etc.|et al.|co.|Co.|Inc.|Ltd.|Corp.|a.m.|p.m.|U.S.|U.K.|E.U."), _PLAIN_LOWER),
            Rule(False, r"(?<!\w)[A-Z]\.", r"\s+[A-Z]\.\s"),
            Rule(True, r"\w(?:…|\.{2,})", _NEW_CLAUSE),
            # A question that is cried out goes on in what it would mean.
            Rule(False, r"\?!", r"\s+(?:That|This|It|Which)\s+(?:would|could|might|may|must)\b"),
        ],
    ),
    "de": Language(
        "[A-Za-zÄÖÜäöüß]",
        _common("der die das und ist nicht ein eine wird mit für von im am den dem zu auf man sich siehe kann aber oder wurde werden warum sonst wie hier sind"),
        [
            Rule(False, _words("z. B.|z.|d. h.|d.|u. a.|u.|o. ä.|i. d. R.|bzw.|ca.|vgl.|Vgl.|Abb.|Tab.|Nr.|Nrn.|Bd.|Kap.|evtl.|ggf.|max.|min.|sog.|inkl.|Hr.|Fr.|Dr.|Prof."), _ALWAYS),
            Rule(False, _words("usw.|usf."), _PLAIN_LOWER),
            Rule(False, r"\b\d{1,2}\.", rf"\s+{_SIGNS}(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b"),
        ],
    ),
    "fr": Language(
        "[A-Za-zÀ-ÿ]",
        _common("le la les des un une et est pas dans pour que du au avec ce cela ne sont il elle sur par voir ou mais pourquoi ici où plus"),
        [
            Rule(False, _words("M.|MM.|Mme.|p. ex.|p.|c.-à-d.|env.|fig.|chap.|éd.|vol.|réf.|Dr.|max.|min."), _ALWAYS),
            Rule(False, _words("no.|nos.|art."), _BEFORE_NUMBER),
            Rule(False, _words("etc."), _PLAIN_LOWER),
        ],
    ),
    "es": Language(
        "[A-Za-zÁ-ú]",
        _common("el la los las un una y en se que por con para es más según véase del al no lo como pero aquí este esta sobra tarda"),
        [
            Rule(False, _words("Sr.|Sra.|Dr.|Dra.|p. ej.|p.|aprox.|núm.|núms.|fig.|pág.|págs.|art.|vol.|máx.|mín."), _ALWAYS),
            Rule(False, _words("Ud.|Uds.|EE. UU.|EE.|etc."), _PLAIN_LOWER),
        ],
    ),
    "ru": Language(
        "[А-Яа-яЁё]",
        _common(""),
        [
            Rule(False, _words("т. е.|т.|См.|см.|рис.|Рис.|табл.|Табл.|ок.|напр.|стр.|гл.|ул.|им.|проф."), _ALWAYS),
            Rule(False, _words("т. д.|т. п.|др.|г.|гг.|в.|вв.|руб.|тыс.|млн."), _PLAIN_LOWER),
        ],
    ),
    "hi": Language("[ऀ-ॿ]", _common(""), [Rule(False, "(?:मि\\.\\s*से\\.|मि\\.|कि\\.\\s*मी\\.|कि\\.|डॉ\\.|श्री\\.|पृ\\.|सं\\.)", _ALWAYS)]),
    "ar": Language("[؀-ۿ]", _common(""), [Rule(False, _words("د.|أ. د.|أ.|م.|ص.|ج.|ق. م.|هـ."), _ALWAYS), Rule(False, _words("إلخ.|الخ."), r"\s+[،؛]")]),
    "th": Language("[\u0e00-\u0e7f]", _common(""), [Rule(False, _words("พ. ศ.|ค. ศ.|พ.|ค.|ดร.|น.|กม.|ซม.|มม.|ก.|อ.|จ.|ต.|เบอร์.|โทร."), _ALWAYS)]),
    "zh": Language("[\u4e00-\u9fff]", _common(""), [Rule(False, "…+", r"(?=[^\s”’」』）】])"), Rule(False, _words("No.|Fig.|fig.|et al."), _BEFORE_NUMBER)]),
    "ja": Language("[\u3041-\u30ff]", _common(""), [Rule(False, "…+", r"(?=[^\s」』）】])")]),
}

_EAST = r"[぀-ヿ㐀-鿿가-힯]"
#: For marks in front of a closing quote: whether the quotation ends the sentence.
AFTER_QUOTE = [
    Rule(True, "", r"\s*$"),
    Rule(False, "", rf"{_PLAIN_LOWER}|\s+{_SIGNS}\d|\s*[,;:，、；：\-–—]"),
    Rule(True, "", rf"\s+{_SIGNS}[\"“„«(¿¡A-ZÀ-ÖØ-ÞА-ЯЁ]"),
    Rule(True, "", rf"\s+{_SIGNS}{_CODE_NAME}\w"),
]
#: For all languages, last in every cascade.
ALL_LANGUAGES = [
    Rule(True, "", r"\s*$"),
    Rule(True, r"[。！？।॥؟۔]", ""),
    Rule(False, r"[)\]]", _PLAIN_LOWER, at_end=True),
    Rule(False, r"…|\.{2,}", _PLAIN_LOWER),
    Rule(True, "", r"\s"),
]

_CLOSERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"'}
_QUOTE = re.compile('[“”„«»「」『』"]')
_CONTINUES = re.compile(rf"{_PLAIN_LOWER}|\s*{_EAST}|\s+{_SIGNS}\d|\s*[,;，、]")
_EASTERN = re.compile(rf"\s*{_EAST}|\s+[ऀ-ॿ؀-ۿ]")
_BLANK_LINE = re.compile(r"\s*$")
_HEADING = re.compile(r"\s*#")
_FENCE = re.compile(r"\s*(```+|~~~+)")
_ITEM = re.compile(r"\s*(?:[-*+•‣·]|\(?(\d{1,4})[.)]|\(?[a-z]\))(?:\s|$)")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_NO_MARKS = re.compile("[฀-໿ក-៿က-႟]")


def _expression(rules: list[Rule]) -> tuple[regex.Pattern, list[bool]]:
    """One expression with an alternative for each rule, in order; its group tells which matched."""
    parts = []
    for r in rules:
        before = f"(?<=(?:{r.before}){'' if r.at_end else _CLOSING})" if r.before else ""
        parts.append(f"{before}(?={r.after})()")
    return regex.compile("|".join(parts)), [r.breaks for r in rules]


@lru_cache(256)
def _cascade(languages: tuple[str, ...]) -> tuple[regex.Pattern, list[bool]]:
    return _expression([r for name in languages for r in LANGUAGES[name].rules] + ALL_LANGUAGES)


@lru_cache(1)
def _after_quote() -> tuple[regex.Pattern, list[bool]]:
    return _expression(AFTER_QUOTE)


def _decided(cascade: tuple[regex.Pattern, list[bool]], text: str, place: int, end: int) -> bool | None:
    """What the first rule that matches at the place says; None if there is none."""
    m = cascade[0].match(text, place, end)
    return None if m is None else cascade[1][m.lastindex - 1]


_SCRIPTS = [(name, re.compile(own.script)) for name, own in LANGUAGES.items()]
_LATIN = [name for name, own in LANGUAGES.items() if re.match(own.script, "a")]
_ANY_COMMON = frozenset().union(*(own.common for own in LANGUAGES.values()))
_SPLIT = re.compile(r"[^\W\d_]+")


def languages_of(text: str, start: int = 0, end: int | None = None) -> tuple[str, ...]:
    """The languages that text[start:end] shows, those of the most common words first.

    A language counts if its script is there and, among those that share a script, it
    has a third of the common words of the one that has most; all do if none has any.
    """
    body = text[start:end]
    here = _LATIN if body.isascii() else [name for name, script in _SCRIPTS if script.search(body)]
    latin = [name for name in here if LANGUAGES[name].common]
    if len(latin) > 1:
        words = [w for w in _SPLIT.findall(body.lower()) if w in _ANY_COMMON]
        shown = {name: sum(map(LANGUAGES[name].common.__contains__, words)) for name in latin}
        most = max(shown.values())
        latin = sorted((name for name in latin if 3 * shown[name] >= most), key=lambda name: -shown[name])
    return (*latin, *(name for name in here if not LANGUAGES[name].common))


def _blank_behind(text: str, start: int, place: int) -> int:
    """Where the blanks in front of the place start."""
    while place > start and text[place - 1].isspace():
        place -= 1
    return place


def _quotations(text: str, start: int, end: int) -> list[tuple[int, int, bool, bool]]:
    """(open, close, goes on in a larger sentence, introduced by a colon) of each closed quotation."""
    out, opened, closing = [], -1, ""
    for m in _QUOTE.finditer(text, start, end):
        if opened >= 0 and m[0] in closing:
            before = _blank_behind(text, start, opened)
            last = text[before - 1] if before > start else ""
            inside = bool(last) and last not in _MARKS + "”»」』"
            out.append((opened, m.start(), inside or _CONTINUES.match(text, m.end(), end) is not None, last in (":", "：") and bool(last)))
            opened = -1
        elif opened < 0 and m[0] in _CLOSERS:
            opened, closing = m.start(), _CLOSERS[m[0]]
    return out


def _may_be_short(text: str, start: int, mark: int) -> bool:
    """Whether a point at mark can belong to a rule of a language: after a last word of an abbreviation, a number, a single letter, or in a script of other signs."""
    at = mark
    while at > start and mark - at < 40 and text[at - 1].isalnum():
        at -= 1
    word = text[at:mark]
    return len(word) < 2 or word[0].isdigit() or word[-1] > "\u052f" or word.lower() in _LAST_WORDS


def _in_brackets(text: str, since: int, mark: int) -> bool:
    """Whether all of text[since:mark] is in brackets that open behind a sentence's end."""
    opened = text.rfind("(", since, mark)
    if opened < 0:
        return False
    before = _blank_behind(text, since, opened)
    return before == since or text[before - 1] in _MARKS


def _ends(text: str, start: int, end: int) -> Iterator[int]:
    """Where sentences of the paragraph text[start:end] end."""
    own: tuple[regex.Pattern, list[bool]] | None = None
    quotes = _quotations(text, start, end)
    following, since = 0, start
    for m in _PLACE.finditer(text, start, end):
        place, mark, mark_end = m.end(), m.start(), m.end(1)
        while following < len(quotes) and quotes[following][1] <= mark:
            following += 1
        quote = quotes[following] if following < len(quotes) and quotes[following][0] < mark else None
        if m[0].endswith("“") and (quote is None or quote[1] != place - 1):
            place = mark_end  # the sign opens the next sentence
        if quote and place <= quote[1]:
            if quote[2]:
                continue
        elif quote:
            if _EASTERN.match(text, place, min(end, place + 3)):
                if quote[3]:
                    yield place
                    since = place
                continue
            if (ruled := _decided(_after_quote(), text, place, end)) is not None:
                if ruled:
                    yield place
                    since = place
                continue
        if ")" in m[0] and _in_brackets(text, since, mark):
            yield place
            since = place
            continue
        if m[1] in ("?!", "…") or m[1].startswith(("..", "…")) or (m[1] == "." and _may_be_short(text, start, mark)):
            if own is None:
                own = _cascade(languages_of(text, start, end))
            cascade = own
        else:
            cascade = _cascade(())
        if _decided(cascade, text, place, end):
            yield place
            since = place


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is one sentence) of headings, list items, code and paragraphs."""
    opened, kind, fence = -1, "", ""
    last = 0
    for m in _LINE.finditer(text):
        line, start = m[0], m.start()
        if not line:
            break
        if fence:
            last = m.end()
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                yield opened, last, True
                opened, kind, fence = -1, "", ""
            continue
        blank, item = _BLANK_LINE.match(line), _ITEM.match(line)
        new = ""
        if not blank:
            if f := _FENCE.match(line):
                new, fence = "fence", f[1]
            elif _HEADING.match(line):
                new = "heading"
            # A number other than 1 at the start of a line within a paragraph belongs to its text.
            elif item and (kind != "paragraph" or item[1] in (None, "1")):
                new = "item"
            elif kind == "item" and line[:2].isspace() and opened >= 0:
                last = m.end()
                continue
            elif _NO_MARKS.search(line):
                new = "line"
            elif kind == "paragraph" and opened >= 0:
                last = m.end()
                continue
            else:
                new = "paragraph"
        if opened >= 0:
            yield opened, last, kind not in ("paragraph", "line")
        opened, kind, last = (-1, "", start) if blank else (start, new, m.end())
    if opened >= 0:
        yield opened, last, kind not in ("paragraph", "line")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of each sentence, blanks around it left out."""
    out = []

    def add(a: int, b: int) -> None:
        own = text[a:b]
        if own and not own.isspace():
            out.append((a + len(own) - len(own.lstrip()), b - len(own) + len(own.rstrip())))

    for start, end, whole in _blocks(text or ""):
        at = start
        if not whole:
            for place in _ends(text, start, end):
                add(at, place)
                at = place
        add(at, end)
    return out


def sentence_units(docs: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """id_col, sentence_no, start_at, end_at and, if asked for, sentence for every sentence of every text, in order.

    Null, empty and blank texts have none. Ids may be null or repeated; the language
    column isn't used, as it may be wrong: what a paragraph shows decides. There is no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, texts = batch["id"].to_numpy()[at : at + 500], batch["text"].to_numpy()[at : at + 500]
                found = [sentences(t) for t in texts]
                counts = np.array([len(own) for own in found], dtype=np.int64)
                places = np.array([place for own in found for place in own], dtype=np.int32).reshape(-1, 2)
                first = np.repeat(np.cumsum(counts) - counts, counts)
                out = pd.DataFrame({"id": pd.Series(np.repeat(ids, counts), dtype=object), "sentence_no": (np.arange(len(places)) - first).astype(np.int32), "start_at": places[:, 0], "end_at": places[:, 1]})
                if with_text:
                    out["sentence"] = pd.Series([t[a:b] for t, own in zip(texts, found, strict=True) for a, b in own], dtype=object)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    # Whole numbers that may be null travel as text, or else they would turn into fractions on the way.
    rows = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null"))
    found = rows.mapInPandas(run, "id string, sentence_no int, start_at int, end_at int" + ", sentence string" * with_text)
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
