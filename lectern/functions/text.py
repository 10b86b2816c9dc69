"""Column functions on text: signals, flags, keys and surface forms.

All are JVM-side expressions except Unicode normalisation and case folding,
which Spark lacks and Arrow UDFs provide.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.pieces import by_list, by_text

#: White space as Unicode has it, with the four information separators.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"
HAN = "㐀-鿿"


def _listed(pairs: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A[\s\x{{1c}}-\x{{1f}}]+", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def text_signals(text: Column) -> Column:
    """Selection cues, in a fixed order."""
    latin, han = text.rlike("[A-Za-z]"), text.rlike(f"[{HAN}]")
    return _listed(
        [
            ("digits", text.rlike("[0-9０-９]")),
            ("latin_and_han", latin & han),
            ("latin", latin & ~han),
            ("repeated_character", text.rlike(r"(?Us)([^\s\x{1c}-\x{1f}\d])\1{2,}")),
            ("bracket_expression", text.rlike(r"\[[^\[\]\r\n]{1,24}\]")),
            ("symbol_or_emoji", text.rlike(r"[\p{So}\p{Sk}\p{Sm}]")),
        ]
    )


def import_flags(text: Column) -> Column:
    return _listed(
        [
            ("multiline_text", text.rlike(r"[\r\n]")),
            ("boundary_whitespace", text != strip(text)),
            ("control_characters", text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")),
        ]
    )


def content_flags(text: Column) -> Column:
    """Flags of a record by its text alone, sorted."""
    found = _listed(
        [
            ("empty_text", strip(text) == ""),
            ("replacement_character", text.contains("\ufffd")),
            ("control_character", text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]")),
            ("short_text", F.length(text) <= 4),
            ("long_text", F.length(text) > 400),
            ("contains_url", text.rlike("https?://")),
            ("contains_at_sign", text.contains("@")),
        ]
    )
    return F.array_sort(found)


def git_blob_sha1(content: Column) -> Column:
    """The id git gives to a file of these bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


_nfc = by_text(lambda t: unicodedata.normalize("NFC", t))
_nfc_each = by_list(lambda t: unicodedata.normalize("NFC", t))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfc(text: Column) -> Column:
    """ASCII is in this form already and never leaves the JVM."""
    return F.coalesce(_nfc(F.when(~is_ascii(text), text)), text)


def nfc_each(texts: Column) -> Column:
    return F.coalesce(_nfc_each(F.when(F.exists(texts, lambda t: ~is_ascii(t)), texts)), texts)


casefold = by_text(lambda t: t.casefold())
#: NFKC, case-folded, without any white space.
normalized_key = by_text(lambda t: "".join(unicodedata.normalize("NFKC", t).casefold().split()))
_squeezed = by_text(lambda t: "".join(unicodedata.normalize("NFKC", t).split()).casefold())


def squeezed(text: Column) -> Column:
    """NFKC without white space, then case-folded; ASCII never leaves the JVM."""
    plain = F.lower(F.regexp_replace(text, r"[\x09-\x0d\x1c-\x20]+", ""))
    return F.when(is_ascii(text), plain).otherwise(_squeezed(F.when(~is_ascii(text), text)))


def masked_signature(tokens: Column) -> Column:
    """A sentence of ``array<struct<is_nc,nc_type,canonical>>`` with every noncanonical token as a mark of its type."""
    said = F.transform(
        tokens,
        lambda t: F.when(t["is_nc"], F.concat(F.lit("<NC:"), F.coalesce(t["nc_type"], F.lit("None")), F.lit(">"))).otherwise(
            F.coalesce(t["canonical"], F.lit(""))
        ),
    )
    return norm(F.array_join(said, " "))


def numeric_template(text: Column) -> Column:
    """The key of a text with every number as a placeholder."""
    return F.regexp_replace(normalized_key(text), r"[0-9]+(\.[0-9]+)*", "<number>")


#: Full-width forms U+FF01 to U+FF5E, and punctuation, with what they become.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_MARKS, _PLAIN = "。“”‘’、", ".\"\"'',"


def _surface(composed: Column) -> Column:
    narrow = F.translate(F.translate(composed, _WIDE, _NARROW), _MARKS, _PLAIN)
    whole = F.regexp_replace(collapse(narrow), f"(?<=[{HAN}]) +| +(?=[{HAN}])", "")
    # Nothing but its white space changes in ASCII.
    return F.when(is_ascii(composed), collapse(composed)).otherwise(whole)


def surface(text: Column) -> Column:
    """The form in which outputs are compared; word boundaries outside Han stay."""
    return _surface(nfc(text))


def surface_each(texts: Column) -> Column:
    """:func:`surface` of every text of an array."""
    return F.transform(nfc_each(texts), _surface)


def norm(text: Column) -> Column:
    return collapse(nfc(text))


def fold(text: Column) -> Column:
    return casefold(norm(text))


def flex(text: Column) -> Column:
    """Folded, without punctuation."""
    return collapse(F.regexp_replace(fold(text), r"\p{P}", ""))


def alternatives(text: Column) -> Column:
    """Comma-separated forms of an annotation; a comma inside a number separates nothing."""
    own = norm(text)
    trimmed = F.transform(
        F.split(own, ","), lambda p: collapse(F.regexp_replace(strip(p), r"\A(?:\p{P}|(?U:\s))+|(?:\p{P}|(?U:\s))+\z", ""))
    )
    parts = F.array_distinct(F.filter(trimmed, lambda p: p != ""))
    return F.when(own.rlike(r"(?U)\d,\d"), F.array(own)).when(F.size(parts) > 0, parts).otherwise(F.array(own))


def escape_separators(line: Column) -> Column:
    """JSON text without the characters that some readers take for line ends."""
    out = line
    for code in ("0085", "2028", "2029"):
        out = F.replace(out, F.lit(chr(int(code, 16))), F.lit(f"\\u{code}"))
    return out


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD, or null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def china_time(epoch: Column) -> Column:
    """Epoch seconds as local time of +08:00."""
    shifted = F.timestamp_seconds(epoch + 8 * 3600)
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
