"""What a line looks like: predicates on a Column of stripped text.

Each list below holds one predicate's expressions; they are joined to one
pattern, so that a line is tested once per predicate.  Expressions that another
one of the list covers are left out, as they change nothing in the joined pattern.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, is_blank, let, strip

_S = f"[{WS}]"
_END = "[。.!！〜~]?"

#: What stands at the head of quoted or forwarded mail.
HEADERS = (
    rf"(?i:-{{3,}}{_S}*Original{_S}+Message{_S}*-{{3,}})",
    rf"(?i:-{{3,}}{_S}*Forwarded{_S}+message{_S}*-{{3,}})",
    rf"(?i:On{_S}+.+wrote:?{_S}*)",
    rf"\d{{4}}年\d{{1,2}}月\d{{1,2}}日.*wrote:?{_S}*",
    r"\d{4}年\d{1,2}月\d{1,2}日.*:",
    rf".*さんからのメール:?{_S}*",
    rf".*さんは.*に書きました:?{_S}*",
    r"転送:.*",
    r"(?i:Fwd:.*)",
    r"(?i:Re:.*)",
    rf"(?i:From:{_S}+.+)",
    rf"差出人:{_S}+.+",
    rf"送信者:{_S}+.+",
    rf"件名:{_S}+.+",
)
#: Openings of a mail.
GREETINGS = (
    ".*お世話になっております.*", ".*お世話になります.*", ".*初めてご連絡.*", ".*初めてメール.*", ".*突然のご連絡.*", ".*突然メール.*", ".*突然のメール.*", ".*ご無沙汰.*",
    ".*(?:ご連絡|ご返信|ご対応|メール)を?ありがとう.*", "拝啓.*", "前略.*", "謹啓.*", "お疲れ様です.*", "お疲れさまです.*", "おつかれさまです.*", "お疲れ様でございます.*",
    ".+(?:様|さん|殿|御中)[,、]?", "(?:こんにちは|おはようございます)[。.]?",
)
#: Endings of a mail.
CLOSINGS = (
    f".*よろしくお願い(?:いた|致)します{_END}", f".*よろしくお願い申し上げます{_END}", f".*よろしくお願いします{_END}", f".*ありがとうござい(?:ます|ました){_END}", f".*失礼(?:いた)?します{_END}",
    ".*(?:何卒|どうぞ|引き続き|今後(?:とも)?)よろしくお願い.*", ".*(?:ご確認|ご検討|ご対応).*よろしくお願い.*", ".*お手数をおかけしますが.*", ".*お手数ですが.*", ".*ご面倒をおかけしますが.*",
    ".*ご返信.*お待ち.*", ".*お返事.*お待ち.*", f"(?:敬具|草々|敬白|謹白|早々|以上です|以上となります|以上){_END}", "以上[、,､].*(?:お願い|ください|下さい).*",
)
#: Ways to reach someone, anywhere in a line.
CONTACTS = (
    rf"(?i:TEL{_S}*:)", rf"(?i:FAX{_S}*:)", rf"(?i:E-?mail{_S}*:)", rf"(?i:Mail{_S}*:)", rf"(?i:URL{_S}*:)", rf"HP{_S}*:",
    rf"(?:電話|携帯|直通|内線|ファックス|ファクス|メール|ホームページ|住所|所在地){_S}*:",
    r"\d{2,4}-\d{2,4}-\d{4}", rf"\(\d{{2,4}}\){_S}*\d{{2,4}}-\d{{4}}", r"0\d{1,3}-\d{1,4}-\d{4}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "https?://", r"www\.", rf"〒{_S}*\d{{3}}-?\d{{4}}", rf"郵便番号{_S}*:?{_S}*\d{{3}}-?\d{{4}}",
)
#: Kinds of companies, anywhere in a line.
COMPANIES = ("株式会社", "有限会社", "合同会社", "合資会社", "合名会社", r"\(株\)", r"\(有\)", "(?i:Inc)", "(?i:Corp)", rf"(?i:Co\.,?{_S}*Ltd)", "(?i:LLC)")
#: Positions, anywhere in a line.
POSITIONS = ("代表取締役", "取締役", "部長", "課長", "係長", "主任", "マネージャー", "リーダー", "担当", "スタッフ", "チーフ", "ディレクター", "エンジニア", "(?i:Manager)", "(?i:Director)", "(?i:Engineer)")
#: Words of a line that speaks about what it shows.
META = ("例えば", "以下の", "下記の", "次の", "サンプル", "具体例", "参考まで", "添付の", "上記の", "前述の")
#: Quoted speech.  The third pair is a comma and a space: any comma before the last space counts, on purpose.
QUOTED = ("「.*」", "『.*』", ",.* ", '".*"')


class Stripped:
    """A text without white space at its ends, which the predicates then need not strip again."""

    def __init__(self, text: Column):
        self.text = text


def _inside(text: Column | Stripped) -> Column:
    return text.text if isinstance(text, Stripped) else strip(text)


def whole(patterns: tuple[str, ...]) -> str:
    return f"^(?:{'|'.join(patterns)})$"


def anywhere(patterns: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(patterns)})"


def quote_depth(text: Column) -> Column:
    """How many quote marks a line starts with."""
    marks = F.regexp_extract(text, rf"^([>|][{WS}>|]*)", 1)
    return F.length(F.regexp_replace(marks, "[^>|]", ""))


def is_forward_reply_header(text: Column | Stripped) -> Column:
    return _inside(text).rlike(whole(HEADERS))


def is_greeting(text: Column | Stripped) -> Column:
    return _inside(text).rlike(whole(GREETINGS))


def is_closing(text: Column | Stripped) -> Column:
    return _inside(text).rlike(whole(CLOSINGS))


def is_contact_info(text: Column) -> Column:
    return text.rlike(anywhere(CONTACTS))


def is_company(text: Column) -> Column:
    return text.rlike(anywhere(COMPANIES))


def is_position(text: Column) -> Column:
    return text.rlike(anywhere(POSITIONS))


def has_meta_discussion(text: Column) -> Column:
    return text.rlike(anywhere(META))


def is_inside_quotation_marks(text: Column | Stripped) -> Column:
    s = _inside(text)
    return s.rlike(anywhere(QUOTED)) | (s == '"')


_HIDDEN = rf"{WS}\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}"
_SPOKEN = r"\p{Lo}\p{Ll}\p{Lu}\p{Lt}\p{N}"


def is_printable(c: Column) -> Column:
    return c.rlike(f"^[^{_HIDDEN}]$")


def is_non_pronounceable(c: Column) -> Column:
    """A character that is neither white space nor a letter with a sound nor a number."""
    return c.rlike(f"^[^{WS}{_SPOKEN}]$")


def is_separator(text: Column) -> Column:
    """At least two visible characters, all without a sound; or one such character three times and in half the line."""

    def judged(x: Column) -> Column:
        n, signs = F.length(x["visible"]), x["signs"]
        chars = F.array_distinct(F.split(signs, ""))
        count = lambda c: F.length(signs) - F.length(F.replace(signs, c, F.lit("")))
        # few lines have as many signs as the second rule asks for, so that most are not taken apart
        often = F.when((F.length(signs) >= 3) & (2 * F.length(signs) >= n), F.exists(chars, lambda c: (c != "") & (count(c) >= 3) & (2 * count(c) >= n))).otherwise(F.lit(False))
        return ((n >= 2) & (signs == x["visible"])) | often

    visible = F.regexp_replace(text, f"[{_HIDDEN}]+", "")
    # what is no sound of the visible characters is what is neither hidden nor a sound of all of them
    return let(F.struct(visible.alias("visible"), F.regexp_replace(text, f"[{_HIDDEN}{_SPOKEN}]+", "").alias("signs")), judged)


@lru_cache
def names() -> dict[str, tuple[str, ...]]:
    """The names that are known: ``last`` and ``first`` as written, ``katakana`` and ``romaji`` of both."""
    from ..sources.names import load_names

    return load_names()


def _any_of(found: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, found), key=lambda x: (-len(x), x))) + ")" if found else r"(?:[^\s\S])"


def name_pattern(known: dict[str, tuple[str, ...]] | None = None) -> str:
    """Known names alone in a line: family name, family and given name, given and family name, or a reading."""
    known = names() if known is None else known
    last, first = _any_of(known["last"]), _any_of(known["first"])
    return f"^(?:{last}{first}?|{first}{last}|{_any_of(known['katakana'])})$"


#: Names that need no list: with a reading, with Latin letters after a slash, in Latin letters only.
NAME_SHAPES = (
    rf"[^{WS}(（]+{_S}*[（(][ァ-ヶー{WS}]+[）)]",
    rf"[^{WS}/]+{_S}*[/／]{_S}*[A-Za-z{WS}]+",
    rf"[A-Z][a-z]+(?:{_S}+[A-Z][a-z]+)+",
)
_NOT_IN_NAMES = "[。、！？!?,.:;]"


def is_name(text: Column | Stripped, known: dict[str, tuple[str, ...]] | None = None) -> Column:
    s = _inside(text)
    listed = (F.length(s) <= 15) & ~s.rlike(_NOT_IN_NAMES) & s.rlike(name_pattern(known))
    return s.rlike(whole(NAME_SHAPES)) | listed


def contains_name(text: Column, known: dict[str, tuple[str, ...]] | None = None) -> Column:
    known = names() if known is None else known
    return text.rlike(_any_of((*known["last"], *known["katakana"]))) | F.lower(text).rlike(_any_of(tuple(x.lower() for x in known["romaji"])))


def line_flags(text: Column | Stripped) -> dict[str, Column]:
    """The nine flags of a line, and its quote depth, header and delimiter marks."""
    full = text.text != "" if isinstance(text, Stripped) else ~is_blank(text)
    own = text.text if isinstance(text, Stripped) else text
    return {
        "quote_depth": quote_depth(own),
        "is_forward_reply_header": is_forward_reply_header(text),
        "is_delimiter": is_separator(own),
        "is_greeting": is_greeting(text),
        "is_closing": is_closing(text),
        "has_contact_info": full & is_contact_info(own),
        "has_company_pattern": full & is_company(own),
        "has_position_pattern": full & is_position(own),
        "has_name_pattern": is_name(text),
        "has_meta_discussion": has_meta_discussion(own),
        "is_inside_quotation_marks": is_inside_quotation_marks(text),
    }
