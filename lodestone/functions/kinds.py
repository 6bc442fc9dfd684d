"""Kind and framework dictionaries as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings of pages and the kind each stands for.
KIND_OF_HEADING = {
    "structure": "struct", "struct": "struct", "class": "class", "protocol": "protocol", "enumeration": "enum", "enum": "enum",
    "macro": "macro", "type alias": "typealias", "typealias": "typealias", "instance method": "method", "type method": "method",
    "class method": "method", "func": "func", "function": "func", "method": "method", "instance property": "property",
    "type property": "property", "class property": "property", "property": "property", "global variable": "var", "variable": "var",
    "var": "var", "initializer": "init", "init": "init", "operator": "op", "case": "case", "subscript": "subscript",
    "instance subscript": "subscript", "type subscript": "subscript", "associated type": "associatedtype", "module": "module",
    "article": "article", "collection": "collection", "ui preview": "ui_preview", "guide": "guide", "tutorial": "tutorial",
    "overview": "overview", "sample code": "sampleCode", "samplecode": "sampleCode", "union": "union", "dictionary": "dictionary",
    "property list key": "property", "object": "dictionary",
}
#: Kinds that satisfy a soft kind filter.
SOFT_KINDS = {
    "func": ("func", "method", "function", "typemethod", "instancemethod", "operator"),
    "function": ("func", "method", "function", "typemethod", "instancemethod", "operator"),
    "method": ("method", "func", "function", "typemethod", "instancemethod"),
    "init": ("init", "initializer", "constructor"),
    "initializer": ("init", "initializer", "constructor"),
    "property": ("property", "var", "variable", "typeproperty", "instanceproperty", "associatedtype"),
    "var": ("property", "var", "variable", "typeproperty", "instanceproperty"),
    "type": ("struct", "class", "enum", "protocol", "typealias"),
    "struct": ("struct", "structure"),
    "class": ("class",),
    "protocol": ("protocol",),
    "enum": ("enum", "enumeration"),
    "typealias": ("typealias",),
    "modifier": ("method", "func", "viewmodifier"),
    "article": ("article", "overview", "tutorial", "guide", "ui_preview"),
    "unknown": ("symbol", "unknown"),
    "symbol": ("symbol", "unknown"),
}
#: Kinds that satisfy a hard kind filter.
HARD_KINDS = {
    "func": ("func", "function", "method", "instancemethod", "typemethod", "init", "initializer"),
    "function": ("func", "function", "method", "instancemethod", "typemethod"),
    "method": ("method", "instancemethod", "typemethod", "func"),
    "var": ("var", "property", "instanceproperty", "typeproperty"),
    "property": ("property", "instanceproperty", "typeproperty", "var"),
    "struct": ("struct", "structure"),
    "structure": ("struct", "structure"),
    "class": ("class",),
    "protocol": ("protocol",),
    "enum": ("enum", "enumeration"),
    "enumeration": ("enum", "enumeration"),
    "macro": ("macro",),
    "typealias": ("typealias",),
    "init": ("init", "initializer"),
}
#: Fixed values.
PRIMARY_KINDS = ("struct", "class", "protocol", "enum", "macro", "union")
UNKNOWN_KINDS = ("symbol", "unknown")
ARTICLE_KINDS = ("article", "overview", "tutorial", "guide", "ui_preview")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value or null; the table is a literal map."""
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def plain(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def is_unknown(kind: Column) -> Column:
    return F.coalesce(plain(kind), F.lit("unknown")).isin(*UNKNOWN_KINDS)


def display(kind: Column) -> Column:
    return F.when(is_unknown(kind), F.lit("unknown")).otherwise(plain(kind))


def is_primary(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*PRIMARY_KINDS), F.lit(False))


def is_article(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*ARTICLE_KINDS), F.lit(False))


def resolve(symbol_kind: Column, heading: Column, kind: Column) -> Column:
    """The kind a page states, else the one its heading stands for, else its plain kind, else unknown."""
    key = plain(kind)
    own = F.when(key.isin(*UNKNOWN_KINDS) | (key == ""), F.lit("unknown")).otherwise(key)
    return F.coalesce(lookup(KIND_OF_HEADING, plain(symbol_kind)), lookup(KIND_OF_HEADING, plain(heading)), own, F.lit("unknown"))
