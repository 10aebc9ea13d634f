"""JSON schemas compiled to Column expressions over VARIANT (part of C3).

A schema is read once on the driver and becomes one native expression. Arrays and
objects of any keys are checked by array functions, whose elements carry their own path,
so a violation names the place it was found at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.text import JSON_TOKENS, bind, json_kind, number_key

TYPES = ("object", "array", "string", "boolean", "null", "number", "integer")
Check = Callable[[Column], Column]
#: Path of a value: known text, or a Column inside arrays and maps.
Path = str | Column


def compile_schema(schema: Mapping | bool) -> Check:
    """A function from a VARIANT Column to the array of its violations.

    All keywords of draft 7 count but ``format``, which is a note, as unknown words are.
    References may point anywhere in the schema itself, but not go round in circles. A schema that
    makes no sense raises here.
    """
    _well_formed(schema, schema, "#", ())
    return lambda value: _checked(value, schema, "", schema)


def schema_problem(spark: SparkSession, text: str) -> str | None:
    """Why a schema, as JSON text, cannot be compiled; its patterns have to compile too."""
    try:
        schema = json.loads(text)
        _well_formed(schema, schema, "#", ())
        for pattern in sorted(set(_patterns(schema))):
            spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (ValueError, IllegalArgumentException) as error:
        said = error.args[0] if isinstance(error, ValueError) else f"pattern {pattern!r} does not compile"
        return f'scorer "json-schema" param "schema" is not a valid JSON Schema: {said}'
    return None


# Reading schemas ------------------------------------------------------------------------

#: Keywords whose value is one schema, a list of schemas, or schemas by name.
_ONE = ("additionalItems", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else")
_LIST = ("allOf", "anyOf", "oneOf")
_NAMED = ("properties", "patternProperties", "definitions", "$defs")
_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def _children(node: Mapping) -> list[tuple[str, object]]:
    """Schemas inside a schema, with the words that lead to them."""
    found = [(key, node[key]) for key in _ONE if key in node]
    items = node.get("items")
    if isinstance(items, list):
        found += [(f"items/{i}", child) for i, child in enumerate(items)]
    elif items is not None:
        found.append(("items", items))
    for key in _LIST:
        if key in node:
            if not isinstance(node[key], list) or not node[key]:
                raise ValueError(f"{key} must be a non-empty array of schemas")
            found += [(f"{key}/{i}", child) for i, child in enumerate(node[key])]
    for key in _NAMED:
        if not isinstance(node.get(key, {}), Mapping):
            raise ValueError(f"{key} must be an object of schemas")
        found += [(f"{key}/{name}", child) for name, child in node.get(key, {}).items()]
    needed = node.get("dependencies", {})
    if not isinstance(needed, Mapping):
        raise ValueError("dependencies must be an object")
    found += [(f"dependencies/{k}", child) for k, child in needed.items() if not isinstance(child, list)]
    return found


def _well_formed(node: object, root: object, where: str, led_by: tuple[str, ...]) -> None:
    """Raise where a schema or a part of it makes no sense."""
    if isinstance(node, bool):
        return
    if not isinstance(node, Mapping):
        raise ValueError(f"the schema at {where} must be an object or a boolean")
    if "$ref" in node:
        if node["$ref"] in led_by:
            raise ValueError(f"the reference {node['$ref']} goes round in circles")
        _well_formed(_referred(root, node["$ref"]), root, node["$ref"], (*led_by, node["$ref"]))
    for name in _types(node):
        if name not in TYPES:
            raise ValueError(f'"{name}" at {where} is not a JSON type')
    for key in _COUNTS:
        if key in node and (not _is_number(node[key]) or node[key] < 0 or node[key] != int(node[key])):
            raise ValueError(f"{key} at {where} must be a whole number from 0 on")
    for key in _NUMBERS:
        if key in node and not _is_number(node[key]):
            raise ValueError(f"{key} at {where} must be a number")
    if node.get("multipleOf", 1) <= 0:
        raise ValueError(f"multipleOf at {where} must be above 0")
    if not isinstance(node.get("enum", []), list):
        raise ValueError(f"enum at {where} must be an array")
    lists = [node.get("required", [])]
    lists += [v for v in node.get("dependencies", {}).values() if isinstance(v, list)] if isinstance(
        node.get("dependencies", {}), Mapping) else []
    if any(not isinstance(names, list) or any(not isinstance(n, str) for n in names) for names in lists):
        raise ValueError(f"required and dependencies at {where} must name properties")
    if not isinstance(node.get("pattern", ""), str):
        raise ValueError(f"pattern at {where} must be a string")
    for step, child in _children(node):
        _well_formed(child, root, f"{where}/{step}", led_by)


def _is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _types(node: Mapping) -> list:
    given = node.get("type", [])
    return [given] if isinstance(given, str) else list(given)


def _patterns(node: object) -> list[str]:
    if not isinstance(node, Mapping):
        return []
    own = [node["pattern"]] if "pattern" in node else []
    own += node.get("patternProperties", {})
    return own + [p for _, child in _children(node) for p in _patterns(child)]


def _referred(root: object, reference: object) -> object:
    """What a reference like #/definitions/line points at."""
    if not isinstance(reference, str) or not re.fullmatch(r"#(/.*)?", reference):
        raise ValueError(f"the reference {reference!r} does not point into the schema itself")
    found = root
    for step in reference.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(found, list) and step.isdigit() and int(step) < len(found):
            found = found[int(step)]
        elif isinstance(found, Mapping) and step in found:
            found = found[step]
        else:
            raise ValueError(f"the reference {reference!r} points at nothing")
    return found


# Violations -----------------------------------------------------------------------------

def _none() -> Column:
    return F.array().cast("array<string>")


def _said(path: Path, message: str | Column) -> Column:
    if isinstance(path, str) and isinstance(message, str):
        return F.lit(f"{path or '(root)'} {message}")
    before = F.lit(path or "(root)") if isinstance(path, str) else path
    return F.concat(before, F.lit(" "), F.lit(message) if isinstance(message, str) else message)


def _below(path: Path, key: str | Column) -> Path:
    """The path of a member; its name is escaped as in a JSON pointer."""
    if isinstance(key, str):
        key = "/" + key.replace("~", "~0").replace("/", "~1")
        return path + key if isinstance(path, str) else F.concat(path, F.lit(key))
    escaped = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("/"), escaped)


def _when(broken: Column, message: Column) -> Column:
    """One violation or none, as an array; an absent value breaks nothing."""
    return F.when(F.coalesce(broken, F.lit(False)), F.array(message)).otherwise(_none())


def _each(items: Column, check: Callable[..., Column]) -> Column:
    """Violations of every element together; of no array there are none."""
    return F.coalesce(F.flatten(F.transform(items, check)), _none())


def _checked(here: Column, node: Mapping | bool, path: Path, root: object) -> Column:
    """Violations of a value; it and its kind are read once."""
    while isinstance(node, Mapping) and "$ref" in node:
        node = _referred(root, node["$ref"])
    if node is False:
        return _when(here.isNotNull(), _said(path, "boolean schema is false"))
    if node is True:
        return _none()

    def found(v: Column, kind: Column) -> Column:
        rules = _violations(v, kind, node, path, root)
        return F.concat(*rules) if rules else _none()

    return bind(here, lambda v: bind(json_kind(v), lambda kind: found(v, kind)))


def _numeric(kind: Column) -> Column:
    """Whether a value of this kind is a number: no other kind lies between - and 9."""
    return (kind >= "-") & (kind <= "9")


def _is_type(v: Column, kind: Column, name: str) -> Column:
    number = _numeric(kind)
    value = F.try_variant_get(v, "$", "double")
    return {
        "object": kind == "{",
        "array": kind == "[",
        "string": kind == '"',
        "boolean": kind.isin("t", "f"),
        "null": kind == "n",
        "number": number,
        "integer": number & (value == F.floor(value)),
    }[name]


def _violations(v: Column, kind: Column, node: Mapping, path: Path, root: object) -> list[Column]:
    """One array per keyword: numbers, texts, any value, arrays, objects."""
    out: list[Column] = []
    names = _types(node)
    if names:
        fits = F.lit(False)
        for name in names + (["null"] if node.get("nullable") is True else []):
            fits = fits | _is_type(v, kind, name)
        out.append(_when(~fits, _said(path, f"must be {','.join(names)}")))
    if node.keys() & {*_NUMBERS}:
        number = F.when(_is_type(v, kind, "number"), F.try_variant_get(v, "$", "double"))
        out.append(bind(number, lambda x: F.concat(*_of_numbers(x, node, path))))
    out += _of_texts(F.when(_is_type(v, kind, "string"), F.try_variant_get(v, "$", "string")), node, path)
    out += _of_any(v, node, path, root)
    if node.keys() & {"maxItems", "minItems", "uniqueItems", "items", "contains"}:
        items = F.when(_is_type(v, kind, "array"), F.try_variant_get(v, "$", "array<variant>"))
        out.append(bind(items, lambda given: F.concat(_none(), *_of_arrays(given, node, path, root))))
    if node.keys() & {
        "maxProperties", "minProperties", "required", "propertyNames", "additionalProperties",
        "dependencies", "properties", "patternProperties",
    }:
        members = F.when(_is_type(v, kind, "object"), F.try_variant_get(v, "$", "map<string,variant>"))
        out.append(bind(members, lambda given: F.concat(_none(), *_of_objects(v, given, node, path, root))))
    return out


def _of_numbers(number: Column, node: Mapping, path: Path) -> list[Column]:
    limits = {
        "maximum": ("<=", lambda x: number > x), "minimum": (">=", lambda x: number < x),
        "exclusiveMaximum": ("<", lambda x: number >= x), "exclusiveMinimum": (">", lambda x: number <= x),
    }
    out = [
        _when(broken(float(node[key])), _said(path, f"must be {sign} {node[key]}"))
        for key, (sign, broken) in limits.items() if key in node
    ]
    if "multipleOf" in node:
        times = number / float(node["multipleOf"])
        out.append(_when(times != F.rint(times), _said(path, f"must be multiple of {node['multipleOf']}")))
    return out


def _of_texts(text: Column, node: Mapping, path: Path) -> list[Column]:
    out = []
    if "maxLength" in node:
        most = int(node["maxLength"])
        out.append(_when(F.length(text) > most, _said(path, f"must NOT have more than {most} characters")))
    if "minLength" in node:
        least = int(node["minLength"])
        out.append(_when(F.length(text) < least, _said(path, f"must NOT have fewer than {least} characters")))
    if "pattern" in node:
        out.append(_when(~text.rlike(node["pattern"]), _said(path, f'must match pattern "{node["pattern"]}"')))
    return out


def _of_any(v: Column, node: Mapping, path: Path, root: object) -> list[Column]:
    def of(child: Mapping | bool) -> Column:
        return _checked(v, child, path, root)

    def ends(found: Column, broken: Callable[[Column], Column], message: str, kept=F.flatten) -> Column:
        """Violations of the branches and the message, where the branches do not do."""
        return bind(found, lambda all_of: F.when(
            F.coalesce(v.isNotNull() & broken(all_of), F.lit(False)),
            F.concat(kept(all_of), F.array(_said(path, message)))).otherwise(_none()))

    def passed(all_of: Column) -> Column:
        return F.size(F.filter(all_of, lambda branch: F.size(branch) == 0))

    out = []
    if "const" in node:
        out.append(_when(_key(v) != _literal_key(node["const"]), _said(path, "must be equal to constant")))
    if "enum" in node:
        hit = F.lit(False)
        for one in node["enum"]:
            hit = hit | (_key(v) == _literal_key(one))
        out.append(_when(~hit, _said(path, "must be equal to one of the allowed values")))
    if "not" in node:
        out.append(_when(v.isNotNull() & (F.size(of(node["not"])) == 0), _said(path, "must NOT be valid")))
    if "anyOf" in node:
        out.append(ends(
            F.array(*map(of, node["anyOf"])), lambda all_of: passed(all_of) == 0, "must match a schema in anyOf"))
    if "oneOf" in node:
        # Branches behind the second one that fits are not looked at.
        def until_the_second(all_of: Column) -> Column:
            return F.flatten(F.filter(all_of, lambda branch, i: passed(F.slice(all_of, F.lit(1), i)) < 2))

        out.append(ends(
            F.array(*map(of, node["oneOf"])), lambda all_of: passed(all_of) != 1,
            "must match exactly one schema in oneOf", until_the_second))
    out += [of(child) for child in node.get("allOf", [])]
    if "if" in node:
        for key, wanted in (("then", True), ("else", False)):
            if key in node:
                applies = (F.size(of(node["if"])) == 0) == F.lit(wanted)
                out.append(ends(
                    F.array(F.when(applies, of(node[key])).otherwise(_none())),
                    lambda all_of: F.size(all_of[0]) > 0, f'must match "{key}" schema'))
    return out


def _of_arrays(items: Column, node: Mapping, path: Path, root: object) -> list[Column]:
    def at(child: Mapping | bool) -> Callable[[Column, Column], Column]:
        return lambda item, i: _checked(item, child, _below(path, i.cast("string")), root)

    out = []
    if "maxItems" in node:
        most = int(node["maxItems"])
        out.append(_when(F.size(items) > most, _said(path, f"must NOT have more than {most} items")))
    if "minItems" in node:
        least = int(node["minItems"])
        out.append(_when(
            items.isNotNull() & (F.size(items) < least), _said(path, f"must NOT have fewer than {least} items")))
    if node.get("uniqueItems") is True:
        out.append(_repeated(items, node.get("items"), path))
    first = node.get("items")
    if isinstance(first, list):
        rest = node.get("additionalItems", True)
        if rest is not True:
            message = _said(path, f"must NOT have more than {len(first)} items")
            out.append(
                _when(F.size(items) > len(first), message) if rest is False else
                _each(items, lambda item, i: F.when(i >= len(first), at(rest)(item, i)).otherwise(_none())))
        out += [F.when(F.size(items) > i, at(child)(F.get(items, F.lit(i)), F.lit(i))).otherwise(_none())
                for i, child in enumerate(first)]
    elif first is not None:
        out.append(_each(items, at(first)))
    if "contains" in node:
        out.append(bind(F.transform(items, at(node["contains"])), lambda all_of: F.when(
            F.coalesce(~F.exists(all_of, lambda one: F.size(one) == 0), F.lit(False)),
            F.concat(F.flatten(all_of), F.array(_said(path, "must contain at least 1 valid item(s)")))
        ).otherwise(_none())))
    return out


def _repeated(items: Column, of_items: object, path: Path) -> Column:
    """The last pair of equal items. Items known to be scalars are told later place first."""
    scalar = isinstance(of_items, Mapping) and bool(_types(of_items)) and not {"object", "array"} & set(_types(of_items))

    def last_of(keys: Column, i: Column) -> Column:
        """The nearest place before i that holds the same, or -1."""
        before = F.reverse(F.slice(keys, F.lit(1), i))
        return i - F.nullif(F.array_position(before, F.get(keys, i)), F.lit(0)).cast("int")

    def pairs(keys: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(keys) - 1)
        return F.filter(
            F.transform(places, lambda i: F.struct(last_of(keys, i).alias("j"), i.alias("i"))),
            lambda p: p["j"].isNotNull())

    def told(found: Column) -> Column:
        pair = F.element_at(F.array_sort(found) if scalar else found, -1)
        one, two = (pair["i"], pair["j"]) if scalar else (pair["j"], pair["i"])
        return F.when(F.coalesce(F.size(found) > 0, F.lit(False)), F.array(_said(path, F.concat(
            F.lit("must NOT have duplicate items (items ## "), one.cast("string"), F.lit(" and "),
            two.cast("string"), F.lit(" are identical)"))))).otherwise(_none())

    several = F.when(F.size(items) > 1, F.transform(items, _key))
    return bind(several, lambda keys: F.when(
        F.size(F.array_distinct(keys)) < F.size(keys), bind(pairs(keys), told)).otherwise(_none()))


def _of_objects(v: Column, members: Column, node: Mapping, path: Path, root: object) -> list[Column]:
    keys, entries = F.map_keys(members), F.map_entries(members)
    out = []

    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    def member(child: Mapping | bool, applies: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda e: F.when(
            applies(e["key"]), _checked(e["value"], child, _below(path, e["key"]), root)).otherwise(_none())

    if "maxProperties" in node:
        most = int(node["maxProperties"])
        out.append(_when(F.size(keys) > most, _said(path, f"must NOT have more than {most} properties")))
    if "minProperties" in node:
        least = int(node["minProperties"])
        out.append(_when(
            members.isNotNull() & (F.size(keys) < least), _said(path, f"must NOT have fewer than {least} properties")))
    for name in node.get("required", []):
        out.append(_when(~has(name), _said(path, f"must have required property '{name}'")))
    if "propertyNames" in node:
        named = node["propertyNames"]
        out.append(_each(keys, lambda key: bind(
            _checked(key.cast("variant"), named, path, root),
            lambda bad: F.when(F.size(bad) > 0, F.concat(bad, F.array(_said(path, "property name must be valid"))))
            .otherwise(_none()))))
    rest = node.get("additionalProperties", True)
    if rest is not True:
        declared = F.array(*map(F.lit, node.get("properties", {}))).cast("array<string>")

        def is_extra(key: Column) -> Column:
            known = F.array_contains(declared, key)
            for pattern in node.get("patternProperties", {}):
                known = known | key.rlike(pattern)
            return ~known

        if rest is False:
            message = _said(path, "must NOT have additional properties")
            out.append(_each(keys, lambda key: F.when(is_extra(key), F.array(message)).otherwise(_none())))
        else:
            out.append(_each(entries, member(rest, is_extra)))
    for name, needed in node.get("dependencies", {}).items():
        if isinstance(needed, list):
            noun = "property" if len(needed) == 1 else "properties"
            message = f"must have {noun} {', '.join(needed)} when property {name} is present"
            out += [_when(has(name) & ~has(other), _said(path, message)) for other in needed]
        else:
            out.append(_checked(F.when(has(name), v), needed, path, root))
    out += [
        _checked(F.try_element_at(members, F.lit(name)), child, _below(path, name), root)
        for name, child in node.get("properties", {}).items()
    ]
    for pattern, child in node.get("patternProperties", {}).items():
        out.append(_each(entries, member(child, partial(Column.rlike, other=pattern))))
    return out


def _literal(value: object) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _literal_key(value: object) -> Column:
    """The key of a known value; of plain scalars it is worked out once, not for every row."""
    if value is None or isinstance(value, bool):
        return F.lit(json.dumps(value))
    if isinstance(value, str) and re.fullmatch(r"[ !#-\[\]-~]*", value):
        return F.lit(f'"{value}"')
    if _is_number(value) and abs(value) < 1 << 53:
        return number_key(F.lit(float(value)))
    return _key(_literal(value))


def _key(v: Column) -> Column:
    """JSON text of a value at any depth, numbers by value, so 1 and 1.0 are the same.

    A VARIANT keeps the keys of objects sorted.
    """
    def keyed(text: Column) -> Column:
        head = F.left(text, F.lit(1))
        tokens = F.transform(
            F.regexp_extract_all(text, F.lit(JSON_TOKENS), F.lit(0)),
            lambda t: F.when(t.rlike("^[-0-9]"), number_key(t.try_cast("double"))).otherwise(t))
        return (
            F.when(head.isin("{", "["), F.array_join(tokens, "\x01"))
            .when(_numeric(head), number_key(text.try_cast("double")))
            .otherwise(text)
        )

    return bind(F.to_json(v), keyed)
