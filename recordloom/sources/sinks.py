"""Records as CSV, JSON and XML: Columns for one record's text, writers for files, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import text
from ..operators.schema import Entity, Segment, parse_name


@dataclass
class Node:
    """A place in the nested view: attributes, children and repeats by name, and a value of its own."""

    attrs: dict[str, Column] = field(default_factory=dict)
    children: dict[str, Node] = field(default_factory=dict)
    arrays: dict[str, list[tuple[list[Segment], Column]]] = field(default_factory=dict)
    value: Column | None = None

    def insert(self, segments: list[Segment], value: Column) -> None:
        head, rest = segments[0], segments[1:]
        if head.repeat:
            self.arrays.setdefault(head.key, []).append((rest, value))
        elif rest:
            self.children.setdefault(head.key, Node()).insert(rest, value)
        elif head.attr:
            self.attrs[head.key] = value
        else:
            self.children.setdefault(head.key, Node()).value = value

    def element(self, parts: list[tuple[list[Segment], Column]], at: Column) -> Node:
        """The node of one element of a repeat."""
        node = Node()
        for rest, values in parts:
            one = F.get(values, at)
            if rest:
                node.insert(rest, one)
            else:
                node.value = one
        return node

    def structured(self) -> Column:
        """Attributes, children, repeats, own value, in this order."""
        if not (self.attrs or self.children or self.arrays):
            return self.value if self.value is not None else F.lit(None).cast("string")
        parts = [v.alias(k) for k, v in self.attrs.items()]
        parts += [n.structured().alias(k) for k, n in self.children.items()]
        for k, own in self.arrays.items():
            parts.append(_each(own, lambda i, o=own: self.element(o, i).structured()).alias(k))
        if self.value is not None:
            parts.append(self.value.alias("_value"))
        return F.struct(*parts)

    def xml(self, name: str, depth: int, shown) -> Column:
        """The element as indented text."""
        pad = "  " * depth
        attrs = F.concat(*[F.concat(F.lit(f' {k}="'), shown(v), F.lit('"')) for k, v in self.attrs.items()]) if self.attrs else F.lit("")
        kids = [F.concat(n.xml(k, depth + 1, shown), F.lit("\n")) for k, n in self.children.items()]
        kids += [F.array_join(F.transform(_each(own, lambda i, o=own, k=k: self.element(o, i).xml(k, depth + 1, shown)), lambda x: F.concat(x, F.lit("\n"))), "") for k, own in self.arrays.items()]
        plain = F.concat(F.lit(f"{pad}<{name}"), attrs, F.lit(">"), shown(self.value) if self.value is not None else F.lit(""), F.lit(f"</{name}>"))
        if not kids:
            return plain
        inner = F.concat(F.lit("  " * (depth + 1)), shown(self.value), F.lit("\n")) if self.value is not None else F.lit("")
        body = F.concat(*kids)
        full = F.concat(F.lit(f"{pad}<{name}"), attrs, F.lit(">\n"), inner, body, F.lit(f"{pad}</{name}>"))
        return full if self.children else F.when(body == "", plain).otherwise(full)


def _each(own: list[tuple[list[Segment], Column]], make) -> Column:
    """One value for each element of the longest of parallel repeats."""
    size = F.greatest(*[F.size(v) for _, v in own], F.lit(0))
    return F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), lambda i: make(i))


def tree(df: DataFrame, names: list[str] | None = None) -> Node:
    root = Node()
    for name in names or df.columns:
        root.insert(parse_name(name), F.col(f"`{name}`"))
    return root


def nested(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Flat records as nested ones."""
    root = tree(df, names).structured()
    return df.select(root.alias("r")).select("r.*")


def json_line(df: DataFrame, names: list[str] | None = None) -> Column:
    """A record as one line of JSON; nulls stay."""
    return F.to_json(tree(df, names).structured(), {"ignoreNullFields": "false"})


def escaped(value: Column) -> Column:
    """A value as XML text."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_record(df: DataFrame, record: str = "record", names: list[str] | None = None, depth: int = 1) -> Column:
    """A record as an indented XML element."""
    return tree(df, names).xml(record, depth, escaped)


def csv_cell(value: Column, kind: T.DataType) -> Column:
    """A cell: lists joined by a bar, quoted only where it must be."""
    if isinstance(kind, T.ArrayType):
        plain = F.array_join(F.transform(value, lambda x: text(x, kind.elementType)), "|", "")
    else:
        plain = text(value, kind)
    plain = F.coalesce(plain, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain.rlike('[",\\n]'), quoted).otherwise(plain)


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in df.columns)


def fingerprint(lines: DataFrame, order: str, line: str) -> DataFrame:
    """32 hex digits that tell whether two runs gave the same records in the same order.

    Records are hashed one by one, then in chunks of consecutive ones, then the chunks: no text is gathered.
    """
    each = lines.select(F.col(order).alias("o"), F.sha2(F.col(line), 256).alias("h"))
    chunks = each.groupBy(F.floor(F.col("o") / 4096).alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    parts = chunks.groupBy(F.floor(F.col("c") / 4096).alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return whole.select(F.substring("h", 1, 32).alias("fingerprint"))


def write_records(df: DataFrame, path: str, kind: str = "json", entity: Entity | None = None, order: str | None = None) -> None:
    """Write records as files, in parallel: csv with a header in each file, JSON lines, or XML."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order).drop(order)
    if kind == "csv":
        flat = df.select(*[(F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string")), "|", "") if isinstance(f.dataType, T.ArrayType) else text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields])
        flat.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind == "xml":
        root, record = (entity.root, entity.record) if entity else ("records", "record")
        shown = df.select(xml_record(df, record).alias("x"))
        parts = shown.mapInPandas(_wrapped(root), "value string")
        parts.write.text(path)
    else:
        df.select(json_line(df).alias("value")).write.text(path)


def _wrapped(root: str):
    def run(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?>', f"<{root}>"]})
        for pdf in batches:
            yield pdf.rename(columns={"x": "value"})
        yield pd.DataFrame({"value": [f"</{root}>"]})

    return run


def serialized(df: DataFrame, kind: str = "json", root: str = "records", record: str = "record", order: str | None = None) -> str:
    """A small table as one text, for replies and archives; streamed from the executors, in order."""
    import json

    names = [c for c in df.columns if c != order]
    ordered = df.orderBy(order) if order else df
    own = ordered.select(*[F.col(f"`{n}`") for n in names])
    if kind == "csv":
        return "\n".join([csv_header(own), *(r[0] for r in own.select(csv_line(own)).toLocalIterator())]) if names else ""
    if kind == "xml":
        body = "\n".join(r[0] for r in own.select(xml_record(own, record)).toLocalIterator())
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n{body}\n</{root}>'
    return json.dumps([json.loads(r[0]) for r in own.select(json_line(own)).toLocalIterator()], indent=2, ensure_ascii=False)

