"""Declared schemas of feature tracks: parse, generate, and turn into Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed names: the types of the language, and the standard fields of BED rows.
PRIMITIVES = {
    "int": T.IntegerType(), "uint": T.LongType(), "short": T.ShortType(), "ushort": T.IntegerType(), "byte": T.ByteType(), "ubyte": T.ShortType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "char": T.StringType(), "string": T.StringType(), "lstring": T.StringType(),
}
BED_FIELDS = [
    ("string", "chrom", "Reference sequence chromosome or scaffold"), ("uint", "chromStart", "Start position in chromosome"), ("uint", "chromEnd", "End position in chromosome"),
    ("string", "name", "Name of item."), ("uint", "score", "Score (0-1000)"), ("char[1]", "strand", "+ or - for strand"),
    ("uint", "thickStart", "Start of where display should be thick (start codon)"), ("uint", "thickEnd", "End of where display should be thick (stop codon)"),
    ("uint", "reserved", "Used as itemRgb as of 2004-11-22"), ("int", "blockCount", "Number of blocks"), ("int[blockCount]", "blockSizes", "Comma separated list of block sizes"),
    ("int[blockCount]", "chromStarts", "Start positions relative to chromStart"), ("int", "expCount", "Experiment count"),
    ("int[expCount]", "expIds", "Comma separated list of experiment ids. Always 0,1,2,3...."), ("float[expCount]", "expScores", "Comma separated list of experiment scores."),
]
TOKEN = re.compile(r'\s*(?:#[^\n]*\n\s*)*("(?:\\.|[^"\\])*"|[A-Za-z_][\w.]*|\d+|[()\[\],;])')


class SchemaError(ValueError):
    """A declaration cannot be parsed."""


@dataclass
class Field:
    type: str
    name: str
    comment: str
    size: str | None = None
    values: list[str] = field(default_factory=list)
    declared: str | None = None
    index: str | None = None
    auto: bool = False

    @property
    def type_text(self) -> str:
        base = f"{self.type}({','.join(self.values)})" if self.values else f"{self.type} {self.declared}" if self.declared else self.type
        return base + (f"[{self.size}]" if self.size else "")


@dataclass
class Declaration:
    kind: str
    name: str
    comment: str
    fields: list[Field]


def parse(text: str) -> list[Declaration]:
    """All declarations of a text; SchemaError with the place for what is no declaration."""
    tokens: list[str] = []
    at = 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            if re.fullmatch(r"\s*(#[^\n]*\n?\s*)*", text[at:]):
                break
            raise SchemaError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def take(*wanted: str) -> str:
        if not tokens or wanted and tokens[-1] not in wanted:
            raise SchemaError(f"expected {' or '.join(wanted) or 'more'}, found {tokens[-1] if tokens else 'the end'}")
        return tokens.pop()

    def quoted() -> str:
        if not tokens or tokens[-1][0] != '"':
            raise SchemaError(f"expected a comment, found {tokens[-1] if tokens else 'the end'}")
        return tokens.pop()[1:-1]

    def name() -> str:
        if not tokens or not re.match(r"[A-Za-z_]", tokens[-1]):
            raise SchemaError(f"expected a name, found {tokens[-1] if tokens else 'the end'}")
        return tokens.pop()

    out: list[Declaration] = []
    while tokens:
        kind = take("simple", "object", "table")
        d = Declaration(kind, name(), quoted(), [])
        take("(")
        while tokens and tokens[-1] != ")":
            f = Field(name(), "", "")
            if f.type in ("simple", "object", "table"):
                f.declared = name()
            elif f.type in ("enum", "set"):
                take("(")
                while tokens and tokens[-1] != ")":
                    f.values.append(take())
                    if tokens and tokens[-1] == ",":
                        take(",")
                take(")")
            elif f.type not in PRIMITIVES:
                raise SchemaError(f"no type named {f.type}")
            if tokens and tokens[-1] == "[":
                take("[")
                f.size = take()
                take("]")
            f.name = name()
            while tokens and tokens[-1] in ("primary", "index", "unique", "auto"):
                word = take()
                if word == "auto":
                    f.auto = True
                    continue
                f.index = word
                if tokens and tokens[-1] == "[":
                    take("[")
                    f.index = f"{word}[{take()}]"
                    take("]")
            take(";")
            f.comment = quoted()
            d.fields.append(f)
        take(")")
        out.append(d)
    return out


def for_columns(n: int) -> str:
    """The declaration of BED rows with n columns: standard fields, then lstring fieldN."""
    fields = BED_FIELDS[: max(3, n)] + [("lstring", f"field{i}", "Undocumented field") for i in range(len(BED_FIELDS) + 1, n + 1)]
    body = "".join(f'    {t:<16} {x + ";":<14} "{c}"\n' for t, x, c in fields)
    return f'table bed\n"Browser Extensible Data"\n(\n{body})\n'


def for_rest(rest: str) -> str:
    """for_columns() of a row with this rest."""
    return for_columns(3 + (len(rest.split("\t")) if rest else 0))


def describe(text: str) -> dict:
    """name, comment and (name, type, comment) of each field of a text's only declaration."""
    found = parse(text)
    if len(found) != 1:
        raise SchemaError(f"{len(found)} declarations, not one")
    d = found[0]
    return {"name": d.name, "comment": d.comment, "fields": [(f.name, f.type_text, f.comment) for f in d.fields]}


def struct(declarations: list[Declaration], which: str | None = None) -> T.StructType:
    """The Spark type of a declaration, the last one by default; comments and indexes are metadata."""
    by_name = {d.name: d for d in declarations}
    d = by_name[which] if which else declarations[-1]
    out = T.StructType()
    for f in d.fields:
        if f.declared:
            if f.declared not in by_name:
                raise SchemaError(f"no declaration named {f.declared}")
            kind: T.DataType = struct(declarations, f.declared)
        elif f.type == "set":
            kind = T.ArrayType(T.StringType())
        else:
            kind = PRIMITIVES.get(f.type, T.StringType())
        if f.size and f.type != "char":
            kind = T.ArrayType(kind)
        out.add(T.StructField(f.name, kind, True, {k: v for k, v in (("comment", f.comment), ("index", f.index), ("auto", f.auto)) if v}))
    return out


def typed(features: DataFrame, text: str) -> DataFrame:
    """chrom, s, e and the further declared fields, taken from rest at its tabs and cast; lists are split at commas."""
    fields = struct(parse(text)).fields[3:]
    parts = F.split(F.coalesce("rest", F.lit("")), "\t")

    def cast(x, kind: T.DataType):
        if isinstance(kind, T.ArrayType):
            return F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda y: y != "").cast(kind)
        return x if isinstance(kind, T.StructType) else x.cast(kind)

    return features.select("chrom", "s", "e", *[cast(F.get(parts, F.lit(i)), f.dataType).alias(f.name, metadata=f.metadata) for i, f in enumerate(fields)])
