"""JSON values of any shape by the VARIANT type: inspected, merged and set, and read out of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import texts

# The names under which an object holds its value, in order; values that count as none.
VALUE_NAMES, NOTHING = ("value", "values", "display_value"), ("null", '""', "0", "0.0", "false", "[]", "{}")
#: What a wrapped property's object fills where it is empty.
WRAPPED = ("value", "source_text", "source_url", "confidence", "status")
#: How deep lists of lists are read; deeper ones stay as their JSON text.
DEPTH = 8


def parsed(text: Column) -> Column:
    """JSON text as a VARIANT; null where the text as a whole is no JSON.

    Spark's parser reads the first value of a text and leaves what follows, so a text that begins with a number would be that
    number alone.  Here it stands in a list before its own digest, which must come out behind it."""
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha1(text), F.lit('"]')))
    whole = F.filter(F.array(held), lambda v: F.try_variant_get(v, "$[1]", "string") == F.sha1(text))
    return F.get(F.transform(whole, lambda v: F.try_variant_get(v, "$[0]", "variant")), F.lit(0))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, VOID, STRING and so on; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def truthy(v: Column) -> Column:
    return F.coalesce(~F.to_json(v).isin(*NOTHING), F.lit(False))


def values(text: Column) -> Column:
    """The parts of a property's value: of JSON text an object's value, the parts of a list's items one by one, and a scalar split
    at commas, semicolons, slashes and bars; of other text the text so split.  Blank parts are left out."""
    v = parsed(text)
    held = lambda x: F.coalesce(*[F.when(truthy(F.try_variant_get(x, f"$.{n}", "variant")), F.try_variant_get(x, f"$.{n}", "variant")) for n in VALUE_NAMES])
    items = lambda x: F.try_variant_get(x, "$", "array<variant>")

    def inner(x: Column) -> Column:
        """What takes the place of an item: an object's value, or a list's items."""
        own = F.when(kind(x) == "OBJECT", F.array(held(x))).otherwise(F.array(x))
        return F.flatten(F.transform(own, lambda y: F.when(kind(y) == "ARRAY", items(y)).otherwise(F.array(y))))

    every = F.array(v)
    for _ in range(DEPTH):
        every = texts.once(every, lambda a: F.flatten(F.transform(a, inner)))
    plain = F.transform(F.filter(every, lambda x: x.isNotNull() & truthy(x)), lambda x: F.when(kind(x).isin("OBJECT", "ARRAY"), F.to_json(x)).otherwise(F.variant_get(x, "$", "string")))
    return F.when(v.isNull(), texts.multi_values(text)).otherwise(F.flatten(F.transform(plain, texts.multi_values)))


def wrapped(raw: Column, current: Mapping[str, Column]) -> dict[str, Column]:
    """The columns of WRAPPED (strings) of a property: as they are, or where they are null or empty what an object in ``raw`` has under
    their names.  Text that is no ``{...}`` or no JSON object fills nothing."""
    body = F.trim(raw)
    v = F.when(body.startswith("{") & body.endswith("}"), parsed(body))
    v = F.when(kind(v) == "OBJECT", v)
    out = {}
    for name in WRAPPED:
        found = F.try_variant_get(v, f"$.{name}", "string")
        found = found if name == "value" else F.nullif(found, F.lit(""))
        out[name] = F.coalesce(F.nullif(current[name], F.lit("")), found, current[name])
    return out


def fields(v: Column) -> Column:
    """An object's fields as a map; null for anything else."""
    return F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))


def merged(left: Column, right: Column) -> Column:
    """JSON text of two objects, the fields of the right one taking the place of equal ones of the left; where one is no object,
    the right one."""
    a, b = parsed(left), parsed(right)
    both = F.map_concat(F.map_filter(fields(a), lambda k, _: ~F.map_contains_key(fields(b), k)), fields(b))
    return F.coalesce(F.to_json(both), right)


def with_value(target: Column, path: Sequence[str], value: Column, create: bool = True) -> Column:
    """JSON text of an object with the JSON text ``value`` at a path of names.  A last name that is missing is made if ``create``;
    if one before it is missing or no object, all stays as it is."""

    def put(v: Column, names: Sequence[str]) -> Column:
        held, name = fields(v), names[0]
        old = F.try_variant_get(v, f"$['{name}']", "variant")
        new = parsed(value) if len(names) == 1 else parsed(put(old, names[1:]))
        fits = F.map_contains_key(held, F.lit(name)) if len(names) > 1 or not create else F.lit(True)
        changed = F.map_concat(F.map_filter(held, lambda k, _: k != name), F.create_map(F.lit(name), new))
        return F.when(held.isNotNull() & F.coalesce(fits, F.lit(False)) & new.isNotNull(), F.to_json(changed)).otherwise(F.to_json(v))

    return put(parsed(target), list(path))


def reply(text: Column, schema: str) -> Column:
    """(valid, data): a model's answer as a struct of ``schema``, read from a fenced block anywhere in it, or else from its first
    ``{`` to its last ``}``.  A list gives its first item; an answer without such an object is not valid and has nulls."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text))
    v = parsed(body)
    v = F.coalesce(v, parsed(F.regexp_extract(body, r"(?s)(\{.*\})", 1)))
    v = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    v = F.when(kind(v) == "OBJECT", v)
    return F.struct(v.isNotNull().alias("valid"), F.from_json(F.to_json(v), schema).alias("data"))
