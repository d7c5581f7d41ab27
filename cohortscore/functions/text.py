"""Keys and classes of names and texts, all as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _plain(text: str) -> bool:
    """Whether any of it outlives `canonical_text`."""
    return any(x.isascii() and x.isalnum() for x in text)


def _tables(last: int = 0x20000) -> tuple[tuple[str, str], dict[str, str]]:
    """Of all characters up to `last`, what their compatibility decomposition leaves: a `translate` pair of those that
    become one letter or digit, with the combining marks, which go, at its end; and those that become several."""
    source, target, marks, several = [], [], [], {}
    for c in map(chr, range(0x80, last)):
        bare = _bare(c)
        if not bare:
            marks.append(c)
        elif bare != c and _plain(bare):
            if len(bare) == 1:
                source.append(c)
                target.append(bare)
            else:
                several[c] = "".join(x if _plain(x) else " " for x in bare)
    return ("".join(source + marks), "".join(target)), several


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD, EXPANDED = _tables()
#: Other spellings of makes. Fixed values.
MAKE_ALIASES = {"vw": "volkswagen", "chevy": "chevrolet", "mercedesbenz": "mercedes benz"}


def _expanded(c: Column) -> Column:
    """Characters that stand for several letters, as these; other texts are not taken apart."""
    table = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in EXPANDED.items())), F.lit("\n"), F.lit("\t"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(F.translate(c, "".join(EXPANDED), "") != c, spelled).otherwise(c)


def canonical_text(c: Column) -> Column:
    """Accents off, lower case, anything but a-z and 0-9 to one space, trimmed; null gives an empty text.

    Only texts with a character beyond ASCII go through the tables."""
    folded = F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(_expanded(c), *FOLD)).otherwise(c)
    return F.coalesce(F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " ")), F.lit(""))


def comparison_make(c: Column, aliases: Mapping[str, str] = MAKE_ALIASES) -> Column:
    key = canonical_text(c)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[key], key)


def comparison_model(c: Column) -> Column:
    """The canonical text without spaces between a letter and a digit."""
    return F.regexp_replace(canonical_text(c), "(?<=[a-z]) (?=[0-9])|(?<=[0-9]) (?=[a-z])", "")


def root_name(c: Column, trims: Sequence[str]) -> Column:
    return F.array_join(F.filter(F.split(comparison_model(c), " "), lambda t: ~t.isin(*trims)), " ")


def entity_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.upper(F.regexp_replace(canonical_text(p.cast("string")), " ", "_")) for p in parts])


def keyword_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], otherwise: str = "unclassified") -> Column:
    """The first class with one of whose words, or its plural, the canonical text has as a whole word; "air bag" is "airbag"."""
    plain, out = F.replace(canonical_text(text), F.lit("air bag"), F.lit("airbag")), F.lit(otherwise)
    for name, words in reversed(classes):
        out = F.when(plain.rlike(rf"\b(?:{'|'.join(map(re.escape, words))})s?\b"), name).otherwise(out)
    return out


def blank_to_null(c: Column) -> Column:
    """White space to single spaces, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, "\\s+", " ")), F.lit(""))


def literal_key(c: Column) -> Column:
    """Lower case with single spaces: no accents or signs are folded."""
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def display_or_key(c: Column, default: str = "sin_categoria") -> Column:
    """The category key of the data layer: canonical text, or the default."""
    return F.coalesce(F.nullif(canonical_text(c), F.lit("")), F.lit(default))


def model_category(c: Column, default: str = "sin_categoria") -> Column:
    """The category key of the model layer: lower case and trimmed, accents kept."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(default))


def description_of(*parts: Column) -> Column:
    """Parts joined by one space; a missing one is an empty text and keeps its place."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def flag(c: Column) -> Column:
    """A flag written as a word; anything else, and null, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "si", "sí"), F.lit(False))


def request_digest(*parts: Column) -> Column:
    """Twelve hex digits that name a request, whatever the case of its parts and the white space around them."""
    bare = [F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), "(?U)^\\s+|\\s+\\z", "") for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.lower(p) for p in bare]), 256), 1, 12)


#: What a reviewer is advised to do. Fixed values.
ADVICE = ("rechazar: puntuacion inferior al umbral de revision", "revisar: aceptar solo si la diferencia es una subversion o acabado", "revisar: rechazar salvo evidencia documental de que ambos nombres son el mismo modelo")
NO_CANDIDATE = "rechazar: no existe candidato con la misma marca y ano"
#: Advice on an accepted match without a valid response. Fixed value.
NO_LABEL = "No transferir una etiqueta: consulta fallida o cero sin verificar."


def review_advice(score: Column, root: Column, other_root: Column, manual: int = 75) -> Column:
    return F.when(score < manual, ADVICE[0]).when((root != "") & (root == other_root), ADVICE[1]).otherwise(ADVICE[2])


def direction(effect: Column) -> Column:
    return F.when(effect > 1e-9, "aumenta_indice").when(effect < -1e-9, "reduce_indice").otherwise("sin_efecto_apreciable")


def first_text(*aliases: Column) -> Column:
    """The first alias, in order of priority, that is not blank."""
    return F.coalesce(*[blank_to_null(a) for a in aliases])


def column_name(name: str) -> str:
    """A column's canonical name: `Engine HP` becomes `engine_hp`."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "_", bare.lower()).strip("_")


def class_weight(name: Column, weights: Mapping[str, float], otherwise: float = 1.0) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[name], F.lit(otherwise))


def digits_of(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), 1)
