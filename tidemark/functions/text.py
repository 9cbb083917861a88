"""Column expressions over codes and names."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of company names that identify none.
GENERIC_TOKENS = (
    "PART", "PARTICIPACOES", "SA", "S", "A", "HOLDING", "HOLDINGS", "GRUPO", "CIA", "COMPANHIA", "BRASIL", "BRASILEIRA", "NACIONAL", "EMPREENDIMENTOS", "COMERCIO",
    "INDUSTRIA", "INDUSTRIAS", "DE", "DO", "DA", "TELEC", "IMOB", "CRUZEIRO", "RAIA",
)
#: Beginnings of share classes that are equity, and classes that are equity as they are.
EQUITY_PREFIXES, EQUITY_EXACT = ("ON", "PN", "PR", "OR"), ("UNT",)


#: What becomes of a byte of a name: letters are upper-case, digits stay, all else parts words.
_WORD_BYTES = bytes(b if chr(b).isalnum() else 32 for b in bytes(range(128)).upper()) + b" " * 128


def _tokens(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def is_equity_class(c: Column) -> Column:
    """Whether a class description's first token begins like an equity class or is one."""
    first = F.coalesce(F.get(_tokens(c), F.lit(0)), F.lit(""))
    return first.rlike("^(" + "|".join(EQUITY_PREFIXES) + ")") | first.isin(*EQUITY_EXACT)


def ex_suffix(c: Column) -> Column:
    """The second token of a class description if it begins with E, else null."""
    second = F.get(_tokens(c), F.lit(1))
    return F.when(second.startswith("E"), second)


def is_level_break(suffix: Column, move: Column, least: float = 0.33) -> Column:
    """B and G break the level, EX from a move of ``least`` on; nothing else does. Null without a suffix."""
    return F.when(suffix.rlike("[BG]"), True).when(suffix == "EX", F.coalesce(F.abs(move) >= least, F.lit(False))).when(suffix.isNotNull(), False)


def scaled_price(cents: Column, factor: Column) -> Column:
    """Cents to units, over the quotation factor; null for a factor of 0."""
    return F.when(factor != 0, cents / 100 / F.when(factor != 0, factor))


def company_id(c: Column) -> Column:
    """14 digits as 00.000.000/0000-00; anything else trimmed and unchanged."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{14}$"), F.regexp_replace(t, "^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")).otherwise(t)


def three_levels(c: Column) -> Column:
    """'a / b / c' as a struct of three levels, null unless there are exactly three that aren't empty."""
    parts = F.transform(F.split(c, " / "), lambda x: F.trim(x))
    level = lambda k: F.get(parts, F.lit(k))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x != ""), F.struct(level(0).alias("sector"), level(1).alias("subsector"), level(2).alias("segment")))


def plain_name(c: Column) -> Column:
    """Upper-case ASCII letters and digits with single spaces between words. Characters are decomposed (NFKD), so accents go
    and ligatures fall apart; what isn't ASCII then is dropped."""
    table = _WORD_BYTES

    def plain(name: bytes) -> bytes:
        if not name.isascii():
            name = unicodedata.normalize("NFKD", name.decode("utf-8", "ignore")).encode("ascii", "ignore")
        return b" ".join(name.translate(table).split())

    def column(names: pa.Array) -> pa.Array:
        return pa.array([None if n is None else plain(n) for n in names.to_pylist()], pa.binary()).cast(pa.string())

    return F.arrow_udf(column, StringType())(c.cast("binary"))


def significant_tokens(c: Column, generic: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    """Different words of a plain name with four letters or more that aren't generic."""
    return F.filter(F.array_distinct(F.split(plain_name(c), " ")), lambda w: (F.length(w) >= 4) & ~w.isin(*generic))


def status_and_title(c: Column) -> Column:
    """Of a Markdown text, the value of its status line and its first heading, null where missing."""
    found = lambda rx: F.nullif(F.trim(F.regexp_extract(c, rx, 1)), F.lit(""))
    return F.struct(found(r"(?im)^[*_\s]*status[*_\s]*:[*_\s]*([^\n*]+)").alias("status"), found(r"(?m)^#\s+([^\n]+)").alias("title"))
