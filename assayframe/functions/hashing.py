"""Content hashes, seeds, fences and flips, all from SHA-256, so that any engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(content: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(content, 256), 1, length)


def record_hash(length: int = 12, **fields: Column) -> Column:
    """Of fields as JSON with sorted keys."""
    return content_hash(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), length)


#: Control characters that Spark's own JSON writes with capitals in their code.
_CAPITAL = "[\\x0b\\x0e\\x0f\\x1a-\\x1f]"


def _quoted(text: Column) -> Column:
    """A string of JSON: short escapes where there are some, other control characters by their codes in small letters, all else as it is."""
    written = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    one = lambda c: F.when(c.rlike(_CAPITAL), F.concat(F.lit("\\u00"), F.lower(F.hex(c)))).otherwise(F.regexp_replace(F.to_json(F.array(c)), r'^\["|"\]$', ""))
    spelled = F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), one), ""), F.lit('"'))
    return F.when(text.rlike(_CAPITAL), spelled).otherwise(written(text))


def _real(value: Column) -> Column:
    """A double in the fewest digits, plain from 0.0001 up to 1e16, else with an exponent of two digits at least."""
    text = value.cast("double").cast("string")
    sign, digits = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", 1)
    fraction, exponent = F.regexp_extract(text, r"\.(\d+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    fraction = F.when(fraction == "0", "").otherwise(fraction)
    large = F.concat(sign, digits, F.rpad(fraction, exponent, "0"), F.lit(".0"))
    split = F.concat(sign, digits, F.substr(fraction, F.lit(1), exponent), F.lit("."), F.substr(fraction, exponent + 1, F.length(fraction)))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits, fraction)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"))
    other = F.concat(sign, digits, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("e"), power)
    moved = F.when(exponent.between(0, 15) & (F.length(fraction) <= exponent), large).when(exponent.between(0, 15), split).when(exponent.between(-4, -1), small).otherwise(other)
    return F.when(exponent.isNull(), F.when(text == "Infinity", "Infinity").when(text == "-Infinity", "-Infinity").otherwise(text)).otherwise(moved)


def canonical_json(value: Column, kind: T.DataType, compact: bool = False) -> Column:
    """A value of any type as JSON with sorted keys at every depth: fields of structs and entries of maps by name, lists in their order, nulls kept.

    Driven by the schema, all in built-in expressions. compact: no space behind commas and colons.
    """
    comma, colon = (",", ":") if compact else (", ", ": ")

    def of(v: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            parts = [F.concat(_quoted(F.lit(f.name)), F.lit(colon), of(v.getField(f.name), f.dataType)) for f in fields]
            text = F.concat(F.lit("{"), F.concat_ws(comma, *parts) if parts else F.lit(""), F.lit("}"))
        elif isinstance(t, T.MapType):
            entries = F.transform(F.array_sort(F.map_keys(v)), lambda k: F.concat(_quoted(k.cast("string")), F.lit(colon), of(F.element_at(v, k), t.valueType)))
            text = F.concat(F.lit("{"), F.array_join(entries, comma), F.lit("}"))
        elif isinstance(t, T.ArrayType):
            text = F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: of(x, t.elementType)), comma), F.lit("]"))
        elif isinstance(t, T.BooleanType):
            text = v.cast("string")
        elif isinstance(t, T.IntegralType):
            text = v.cast("string")
        elif isinstance(t, T.DoubleType | T.FloatType):
            text = _real(v)
        else:
            text = _quoted(v.cast("string"))
        return F.when(v.isNotNull(), text).otherwise("null")

    return of(value, kind)


def nested_hash(value: Column, kind: T.DataType, length: int = 12) -> Column:
    """content_hash of a nested value, whatever the order in which its fields and entries come."""
    return content_hash(canonical_json(value, kind), length)


def case_seed(case_id: Column, base_seed: int | Column) -> Column:
    """A seed of 32 bits for each case."""
    base = base_seed if isinstance(base_seed, Column) else F.lit(base_seed)
    return F.conv(F.substring(F.sha2(F.concat_ws(":", base.cast("string"), case_id.cast("string")), 256), 1, 8), 16, 10).cast("long")


def flip(*parts: Column | str) -> Column:
    """A coin for the order of presentation, by whatever names the pair."""
    key = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 2 == 1


def fence_nonce(text: Column, salt: str = "", length: int = 10) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), text), 256), 1, length)


def sealed(text: Column, salt: str = "") -> Column:
    """text between marks that it cannot forge: the mark's word is spoiled wherever the text has it."""
    nonce = fence_nonce(text, salt)
    body = F.regexp_replace(text, "(?i)answer-fence", "answer fence")
    return F.concat(F.lit("<answer-fence-"), nonce, F.lit(">\n"), body, F.lit("\n</answer-fence-"), nonce, F.lit(">"))
