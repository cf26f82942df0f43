"""Text functions as columns: normal forms, tokens, set similarities, cues, name keys.

Two kinds of word list are kept apart by use, as they differ. Pattern classes are Unicode-aware
(``(?U)``), as Spark's are ASCII otherwise. Spark has no Unicode normalisation, so ``nfc`` puts
letters and combining marks together by a table, and only in texts that hold such marks.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
STOPWORDS = (
    "và là của có không được cho này đó các một những để với trong về đã sẽ thì mà nhưng cũng khi nếu như hay hoặc"
    " tại theo từ đến sau trước vì nên rằng vẫn còn lại"
).split()
SIMILARITY_STOPWORDS = (
    "và của cho các những một được để là thì sẽ đã với trong theo về từ khi này đó lại ra vào cũng như nhằm việc thực hiện"
    " giao thống nhất"
).split()
SCORING_STOPWORDS = (
    "và với của cho các những là thì mà để được bị có không này đó kia ở trong trên dưới từ đến tới về theo khi nếu như"
    " cũng đã đang sẽ rồi lại ra vào lên nữa một hai ba hết phải cần nên làm việc anh chị em ông bà cô chú bác tôi mình"
    " chúng ta họ bên phía phần lúc nào gì ạ dạ vâng nhé"
).split()
HEDGE_CUES = (
    "đề xuất, có thể, cân nhắc, nên chăng, dự kiến, gợi ý, chưa chốt, xem xét thêm, để xem xét, nghiên cứu thêm,"
    " tính sau, hay là, liệu có, ghi nhận"
).split(", ")
COMMIT_CUES = (
    "giao cho, giao nhiệm vụ, giao việc, giao em, giao anh, giao chị, chốt, thống nhất, đồng ý, phân công, yêu cầu,"
    " chỉ đạo, chủ trì, kết luận, quyết định, phụ trách, trước ngày, thời hạn, hạn chót, nhất trí, triển khai ngay,"
    " đảm nhận, nhé, em nhận, tôi nhận, em làm, để em, em sẽ, tôi sẽ, bên em sẽ, chúng tôi sẽ"
).split(", ")
HONORIFICS = "anh chị em bạn cô chú bác ông bà".split()
ADDRESS_PREFIXES = "đồng chí, đ/c, anh, chị, em, bạn, cô, chú, bác, ông, bà".split(", ")
SCORING_HONORIFICS = "đồng chí, đ/c, anh, chị, em, ông, bà, cô, chú, bác, thầy, bạn".split(", ")
PRONOUNS = (
    "em, anh, chị, tôi, mình, ta, bọn em, bọn anh, bọn chị, bọn mình, bọn tôi, chúng em, chúng anh, chúng tôi,"
    " chúng mình, chúng ta, các em, các anh, các chị"
).split(", ")
VAGUE_ACTORS = "nhóm, cả nhóm, nhóm phụ trách, một thành viên, một thành viên khác, team, mọi người, các bên liên quan".split(", ")
ABBREVIATIONS = {"ubnd": "ủy ban", "hđnd": "hội đồng", "tp": "thành phố"}
ORGANIZATION_WORDS = (
    "sở, ban, ủy ban, hội đồng, bộ, cục, chi cục, tổng cục, phòng, văn phòng, trung tâm, công ty, tổng công ty,"
    " thành ủy, đảng ủy, cảng vụ, viện, tổ công tác"
).split(", ")
MIN_JACCARD, MIN_OVERLAP = 0.45, 0.7
# -----------------------------------------------------------------------------------------------


@cache
def _compositions() -> str:
    """Every way to write a Latin letter with marks apart, and the letter, as pairs for ``str_to_map``."""
    found: dict[str, str] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        for order in itertools.permutations(marks):
            for k in range(len(order)):  # some marks may be on the letter already
                head = unicodedata.normalize("NFC", base + "".join(order[:k]))
                said = head + "".join(order[k:])
                if len(head) == 1 and unicodedata.normalize("NFC", said) == letter:
                    found[said] = letter
    return "\x01".join(f"{k}\x02{v}" for k, v in found.items())


def nfc(text: Column) -> Column:
    """Unicode normal form C of Latin letters with combining marks, Vietnamese ones among them."""
    table = F.str_to_map(F.lit(_compositions()), F.lit("\x01"), F.lit("\x02"))
    letters = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)\P{M}\p{M}*|\p{M}"), F.lit(0))
    one = lambda g: F.when(F.length(g) > 1, F.coalesce(F.try_element_at(table, g), g)).otherwise(g)
    whole = lambda t: F.when(t.rlike(r"\p{M}"), F.array_join(F.transform(letters(t), one), "")).otherwise(t)
    return F.get(F.transform(F.array(text), whole), F.lit(0))  # the text is worked out once


def squeeze(text: Column) -> Column:
    """In normal form, white space runs as one space, edges trimmed."""
    return F.trim(F.regexp_replace(nfc(text), r"(?U)\s+", " "))


def word_tokens(text: Column) -> Column:
    """Lower-case word runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(r"(?U)\w+"), F.lit(0))


def _words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def without(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Tokens that are no stopwords; repeats stay, unlike array_except."""
    stop = _words(stopwords)
    return F.filter(tokens, lambda x: ~F.array_contains(stop, x))


def content_tokens(text: Column, stopwords: Iterable[str] = tuple(SIMILARITY_STOPWORDS)) -> Column:
    """The set of tokens of two letters or more that are no stopwords."""
    return F.array_distinct(F.filter(without(word_tokens(text), stopwords), lambda x: F.length(x) > 1))


def syllables(text: Column, stopwords: Iterable[str] = tuple(SCORING_STOPWORDS)) -> Column:
    """The set of tokens that scoring compares."""
    return F.array_distinct(without(word_tokens(text), stopwords))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    pairs = F.transform(tokens, lambda x, i: F.concat(x, F.lit(" "), F.coalesce(F.get(tokens, i + 1), F.lit(""))))
    return F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def dice(a: Column, b: Column) -> Column:
    """2|A∩B| / (|A|+|B|) of two sets; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(2 * _common(a, b) / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(_common(a, b) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """|A∩B| / min(|A|, |B|)."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(_common(a, b) / F.least(F.size(a), F.size(b)))


def same_content(a: Column, b: Column) -> Column:
    """Whether two sets of content tokens say the same thing: alike enough both ways."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= MIN_JACCARD) & (overlap(a, b) >= MIN_OVERLAP)


def find_cues(text: Column, cues: Iterable[str]) -> Column:
    """The cues that stand in the text as whole words, in the cues' order."""
    inside = lambda t, c: t.rlike(r"(?U)(?<!\w)" + _quote(c) + r"(?!\w)")
    every = lambda t: F.filter(F.array(*[F.when(inside(t, c), F.lit(c)) for c in cues]), lambda x: x.isNotNull())
    return F.get(F.transform(F.array(F.lower(squeeze(text))), every), F.lit(0))  # the text is made ready once


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def _any_of(words: Iterable[str]) -> str:
    return "|".join(_quote(w) for w in sorted(words, key=len, reverse=True))


def name_key(name: Column) -> Column:
    """The key by which people and organisations are matched: no parentheses, no leading form of address, long forms of abbreviations."""
    key = F.lower(squeeze(F.regexp_replace(name, r"\([^)]*\)", " ")))
    key = F.replace(key, F.lit("uỷ"), F.lit("ủy"))
    for short, long in ABBREVIATIONS.items():
        key = F.regexp_replace(key, rf"(?U)(?<!\w){short}(?!\w)\.?", long)
    key = F.regexp_replace(key, r"(?U)(?<!\w)(ủy ban|hội đồng) nhân dân(?!\w)", "$1")
    key = F.regexp_replace(key, rf"(?U)^(?:{_any_of(ADDRESS_PREFIXES)})\s+(?=\S)", "")
    return squeeze(key)


def grouping_key(name: Column) -> Column:
    """The key by which assignments of one actor are grouped: one leading honorific less."""
    return F.regexp_replace(F.lower(squeeze(name)), rf"(?U)^(?:{_any_of(HONORIFICS)})\s+(?=\S)", "")


def scoring_name(name: Column) -> Column:
    """The name that scoring compares: all leading honorifics go, a bare one leaves nothing."""
    key = F.lower(squeeze(F.regexp_replace(name, r"\([^)]*\)", " ")))
    return F.trim(F.regexp_replace(key, rf"(?U)^(?:(?:{_any_of(SCORING_HONORIFICS)})(?:\s+|$))+", ""))


def is_pronoun(name: Column) -> Column:
    return F.lower(squeeze(name)).isin(PRONOUNS)


def is_vague(name: Column) -> Column:
    """Whether a name points at nobody in particular."""
    return is_pronoun(name) | F.lower(squeeze(name)).isin(VAGUE_ACTORS)


def looks_like_organization(name: Column) -> Column:
    return name_key(name).rlike(rf"(?U)^(?:{_any_of(ORGANIZATION_WORDS)})(?!\w)")


def given_name(name: Column) -> Column:
    return F.element_at(F.split(name_key(name), " "), -1)


def bare_id(raw: Column) -> Column:
    """``[T1|Name]`` and ``<130>`` without their decoration."""
    inner = F.regexp_extract(F.trim(raw), r"^[\[<]\s*([^|\]>]*?)\s*(?:\|[^\]>]*)?[\]>]$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(raw))


def cited_ids(text: Column, pattern: str = r"TURN_\d{6}") -> Column:
    """The ids that a text cites, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def trailing_number(text: Column) -> Column:
    digits = F.regexp_extract(text, r"(\d+)\D*$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def turn_chars(speaker: Column, text: Column) -> Column:
    """The length of a turn as it is rendered; a null speaker is rendered as None."""
    return F.length(F.concat(F.coalesce(speaker, F.lit("None")), F.lit(": "), text)) + 1


def url_quoted(text: Column) -> Column:
    """Percent encoding that keeps letters, digits and ``-._~``; Spark's own is that of forms."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_deadline_echo(text: Column, raw: Column) -> Column:
    """The text without a closing "(hạn: …)" where the deadline is held apart."""
    bare = F.trim(F.regexp_replace(text, r"(?iU)\s*\((?:hạn(?: chót)?|thời hạn|deadline)\s*:[^)]*\)\s*\.?$", ""))
    return F.when(raw.isNotNull(), bare).otherwise(text)


def is_assignment_point(text: Column) -> Column:
    """Whether a discussion point only hands out a task."""
    return F.lower(squeeze(text)).rlike(
        rf"(?U)^(?:phân công|giao (?:nhiệm vụ|việc|cho)|giao (?=(?:{_any_of([*HONORIFICS, 'đồng chí', 'đ/c'])})(?!\w)))(?!\w)?"
    ) | F.trim(text).rlike(r"(?U)^(?i:giao)\s+\p{Lu}")


def initials(name: Column) -> Column:
    """The first letters of the first and last word."""
    words = F.filter(F.split(squeeze(name), " "), lambda w: w != "")
    first, last = F.upper(F.substring(F.get(words, F.lit(0)), 1, 1)), F.upper(F.substring(F.element_at(words, -1), 1, 1))
    return F.when(F.size(words) == 0, F.lit("?")).when(F.size(words) == 1, first).otherwise(F.concat(first, last))
