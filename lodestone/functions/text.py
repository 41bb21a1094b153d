"""Text functions: analysis, templates, hashes and formats, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import TemplateError

#: English function words that a query highlight and the analyser leave out.
STOP_WORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer es für ich im in ist mit nach nicht oder sich sie sind so und von war wie zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split(),
    "es": "al como con de del el ella en entre es la las le lo los más no o para pero por que se sin su sus un una y".split(),
}
#: Language codes and their names; the last lines are known besides.
LANGUAGES = {
    "en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "ru": "russian", "ja": "japanese", "zh": "chinese", "ar": "arabic", "da": "danish",
    "nl": "dutch", "fi": "finnish", "hu": "hungarian", "no": "norwegian", "ro": "romanian", "sv": "swedish", "tr": "turkish", "id": "indonesian", "ms": "malay", "vi": "vietnamese", "th": "thai",
    "cs": "czech", "el": "greek", "is": "icelandic", "pl": "polish", "sk": "slovak", "sl": "slovenian", "et": "estonian", "lv": "latvian", "lt": "lithuanian",
    "bg": "bulgarian", "bn": "bengali", "ca": "catalan", "eu": "basque", "fa": "persian", "ga": "irish", "gl": "galician", "hi": "hindi", "hy": "armenian",
}
#: Scripts that write no space between words: each letter is a token.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
TOKEN_GAP = r"[^\p{L}\p{N}]+"


def tokens(c: Column, stop: Sequence[str] = (), fold: bool = False, scripts: bool = False) -> Column:
    """Words in lower case; with ``fold``, accents of Latin letters are removed; null has none.

    With ``scripts`` each letter of a script that writes no spaces is a token of its own.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    if fold:
        low = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    if scripts:
        low = F.regexp_replace(low, f"({UNSPACED})", " $1 ")
    words = F.filter(F.split(low, TOKEN_GAP), lambda t: t != "")
    return F.filter(words, lambda t: ~t.isin(list(stop))) if stop else words


def language_name(c: Column) -> Column:
    """Name of a language code; an unknown code raises when the row is computed."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(names[c], F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("unknown language "), c)).cast("string")))


_PART = re.compile(r"\{\{\s*(\w+)\s*\}\}|\{%-?\s*(if\s+(\w+)|endif)\s*-?%\}")


def template_variables(template: str) -> list[str]:
    """Names that a template reads, in the order of their first occurrence."""
    return list(dict.fromkeys(m.group(1) or m.group(3) for m in _PART.finditer(template) if m.group(1) or m.group(3)))


def render(template: str, columns: Sequence[str] | None = None, values: Mapping[str, Column] | None = None) -> Column:
    """A template of literal text, ``{{ x }}`` and ``{% if x %}...{% endif %}`` as a Column.

    A null variable renders as nothing, and an ``if`` holds for a value that is neither null nor
    empty. Other syntax, unbalanced blocks and unknown variables raise ``TemplateError``.
    """
    names = template_variables(template)
    if columns is not None and (missing := [n for n in names if n not in columns]):
        raise TemplateError(f"template variables {missing} are not among the columns {sorted(columns)}")
    col = lambda n: (values or {}).get(n, F.col(f"`{n}`"))
    stack: list[tuple[str | None, list[Column]]] = [(None, [])]
    at = 0
    for m in _PART.finditer(template):
        literal = template[at : m.start()]
        if "{{" in literal or "{%" in literal:
            raise TemplateError(f"not supported: {literal!r}")
        if literal:
            stack[-1][1].append(F.lit(literal))
        if m.group(1):
            stack[-1][1].append(F.coalesce(col(m.group(1)).cast("string"), F.lit("")))
        elif m.group(3):
            stack.append((m.group(3), []))
        else:
            name, parts = stack.pop()
            if name is None:
                raise TemplateError("endif without if")
            body = F.concat(*parts) if parts else F.lit("")
            stack[-1][1].append(F.when(F.coalesce(col(name).cast("string"), F.lit("")) != "", body).otherwise(F.lit("")))
        at = m.end()
    if len(stack) > 1:
        raise TemplateError(f"if {stack[-1][0]} is not closed")
    rest = template[at:]
    if "{{" in rest or "{%" in rest:
        raise TemplateError(f"not supported: {rest!r}")
    parts = [*stack[0][1], *([F.lit(rest)] if rest else [])]
    return F.concat(*parts) if parts else F.lit("")


def section_hash(content: Column, title: Column) -> Column:
    """Identity of a section by content and title; null is the empty text."""
    c = F.coalesce(content, F.lit(""))
    return F.concat(F.md5(F.concat(c, F.coalesce(title, F.lit("")))), F.lit("-"), F.length(c).cast("string"))


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_"))


def human_number(c: Column, base: float = 1000.0) -> Column:
    """A number with one decimal and a suffix K, M, G or T."""
    out = None
    for suffix, power in (("T", 4), ("G", 3), ("M", 2), ("K", 1)):
        cond = F.abs(c) >= F.lit(base**power)
        text = F.concat(F.format_string("%.1f", F.round(c / F.lit(base**power), 1)), F.lit(suffix))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return F.when(c.isNotNull(), out.otherwise(F.format_string("%.1f", c.cast("double"))))


def highlight(text: Column, words: Sequence[str], left: str = "[", right: str = "]") -> Column:
    """Marks whole words of ``text`` that are among ``words`` and no stop words."""
    kept = [w for w in dict.fromkeys(re.sub(r"\W+", "", w).lower() for w in words) if w and w not in STOP_WORDS["en"]]
    if not kept:
        return text
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(map(re.escape, kept)) + r")\b", f"{left}$1{right}")
