"""One text per relational plan, rendered for Spark SQL and, as the independent check, for DuckDB.

A plan is a SELECT over base tables and adapter views (see :mod:`.adapters`). Where the two dialects spell a function
differently the text holds a macro ``@NAME(a, b)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _duck_regex(replacement: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", replacement)


#: Letters whose upper case Spark spells with several letters, and the one letter of each in the simple mapping (DuckDB's).
_LONG = "".join(c for c in map(chr, range(0x80, 0xFFFF)) if len(c.upper()) > 1)
_SHORT = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG)


def _upper(s: str) -> str:
    """Letter by letter where a text has one of them."""
    letter = f"case when contains('{_LONG}', c) then translate(c, '{_LONG}', '{_SHORT}') else upper(c) end"
    return f"case when {s} rlike '[{_LONG}]' then array_join(transform(split({s}, ''), c -> {letter}), '') else upper({s}) end"


#: name -> (Spark, DuckDB)
MACROS: dict[str, tuple[Callable[..., str], Callable[..., str]]] = {
    "DAYS": (lambda a, b: f"cast(datediff({a}, {b}) as bigint)", lambda a, b: f"cast(date_diff('day', cast({b} as date), cast({a} as date)) as bigint)"),
    "RX": (lambda s, p, r: f"regexp_replace({s}, {p}, {r})", lambda s, p, r: f"regexp_replace({s}, {p}, {_duck_regex(r)}, 'g')"),
    "MATCH": (lambda s, p: f"({s} rlike {p})", lambda s, p: f"regexp_matches({s}, {p})"),
    "UPPER": (_upper, lambda s: f"upper({s})"),
    "LOWER": (lambda s: f"lower(translate({s}, 'İΣ', 'iσ'))", lambda s: f"lower({s})"),
    "BROUND": (lambda x, n: f"bround({x}, {n})", lambda x, n: f"round_even({x}, {n})"),
    "INTDIV": (lambda a, b: f"(({a}) div ({b}))", lambda a, b: f"(({a}) // ({b}))"),
    "LISTAGG": (lambda x, s, o: f"listagg({x}, {s}) within group (order by {o})", lambda x, s, o: f"string_agg({x}, {s} order by {o})"),
    "DOT": (
        lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)",
        lambda a, b: f"list_inner_product(cast({a} as double[]), cast({b} as double[]))",
    ),
    "L2": (
        lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - cast(y as double)) * (cast(x as double) - cast(y as double))), 0D, (s, x) -> s + x))",
        lambda a, b: f"list_distance(cast({a} as double[]), cast({b} as double[]))",
    ),
    "CONTAINS": (lambda a, b: f"contains({a}, {b})", lambda a, b: f"contains({a}, {b})"),
    "EXPLODE": (lambda a: f"explode({a})", lambda a: f"unnest({a})"),
    "RANGE": (lambda a, b, s: f"sequence({a}, {b}, {s})", lambda a, b, s: f"generate_series({a}, {b}, {s})"),
    "ARRAY": (lambda *x: f"array({', '.join(x)})", lambda *x: f"[{', '.join(x)}]"),
    "SPLIT": (lambda s, d: f"split({s}, {d})", lambda s, d: f"string_split({s}, {d})"),
    "SIZE": (lambda a: f"cast(size({a}) as bigint)", lambda a: f"cast(len({a}) as bigint)"),
    "FILTER": (lambda a, f: f"filter({a}, {f})", lambda a, f: f"list_filter({a}, {f})"),
    "MAP": (lambda a, f: f"transform({a}, {f})", lambda a, f: f"list_transform({a}, {f})"),
    "DISTINCT": (lambda a: f"array_distinct({a})", lambda a: f"list_distinct({a})"),
    "BOTH": (lambda a, b: f"array_intersect({a}, {b})", lambda a, b: f"list_intersect({a}, {b})"),
    "JOIN": (lambda a, s: f"array_join({a}, {s})", lambda a, s: f"array_to_string({a}, {s})"),
    "SORTED": (lambda a: f"array_sort({a})", lambda a: f"list_sort({a})"),
    "COLLECT": (lambda a: f"collect_list({a})", lambda a: f"list({a})"),
    "COLLECTSET": (lambda a: f"collect_set({a})", lambda a: f"list(distinct {a}) filter (where {a} is not null)"),
    "SUBSTR": (lambda s, a, n: f"substring({s}, {a}, {n})", lambda s, a, n: f"substring({s}, {a}, {n})"),
    "SLICE": (lambda a, i, n: f"slice({a}, {i}, {n})", lambda a, i, n: f"list_slice({a}, {i}, {i} + {n} - 1)"),
    "AT": (lambda a, i: f"try_element_at({a}, {i})", lambda a, i: f"list_extract({a}, {i})"),
    "JSON": (lambda s, k: f"get_json_object({s}, {k})", lambda s, k: f"json_extract_string({s}, {k})"),
    "OBJECT": (lambda *x: f"to_json(named_struct({', '.join(x)}))", lambda *x: f"cast(json_object({', '.join(x)}) as varchar)"),
    "TOJSON": (lambda a: f"to_json({a})", lambda a: f"cast(to_json({a}) as varchar)"),
    "FMT": (lambda t, s, d: f"date_format({t}, {s})", lambda t, s, d: f"strftime({t}, {d})"),
    "PLUSDAYS": (lambda t, n: f"({t} + make_dt_interval({n}))", lambda t, n: f"({t} + to_days(cast({n} as integer)))"),
    "SECONDS": (lambda a, b: f"cast(timestampdiff(second, {b}, {a}) as bigint)", lambda a, b: f"cast(date_diff('second', {b}, {a}) as bigint)"),
    "FIND": (lambda s, x: f"instr({s}, {x})", lambda s, x: f"instr({s}, {x})"),
    "LASTSET": (lambda x: f"last_value({x}, true)", lambda x: f"last_value({x} ignore nulls)"),
    "TRYINT": (lambda s: f"try_cast({s} as bigint)", lambda s: f"case when regexp_matches({s}, '^\\s*[+-]?[0-9]+\\s*$') then try_cast({s} as bigint) end"),
    "URLDECODE": (lambda s: f"url_decode(replace({s}, '+', '%2B'))", lambda s: f"url_decode({s})"),
    "LITERALS": (lambda *x: "(select explode(array(" + ", ".join(x) + ")) as v)", lambda *x: "(select unnest([" + ", ".join(x) + "]) as v)"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at ``at``, and the place behind it."""
    depth, begun, out, quoted = 0, at + 1, [], False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return [x.strip() for x in [*out, text[begun:i]] if x.strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[begun:i])
            begun = i + 1
    raise ValueError(f"unclosed call: {text[at : at + 60]}")


def render(text: str, duck: bool) -> str:
    while m := re.search(r"@([A-Z0-9]+)\((?!.*@[A-Z0-9]+\()", text, re.S):
        args, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + MACROS[m[1]][duck](*args) + text[end:]
    if duck:
        return re.sub(r"\b(\w+) -> ", r"lambda \1: ", text)
    return text.replace("\\", "\\\\")  # Spark reads escapes in literals


def with_views(text: str, views: dict[str, str]) -> str:
    """The SELECT behind a WITH clause of the views it uses, directly or by way of others."""
    needed: dict[str, None] = {}

    def add(body: str) -> None:
        for name, view in views.items():
            if name not in needed and re.search(rf"\b{name}\b", body):
                add(view)
                needed[name] = None

    add(text)
    if not needed:
        return text
    clauses = ", ".join(f"{n} AS ({views[n]})" for n in needed)
    m = re.match(r"\s*with\s+(recursive\s+)?", text, re.I)
    return f"WITH {m[1] or ''}{clauses}, {text[m.end():]}" if m else f"WITH {clauses} {text}"


def used_tables(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text, re.I)]


def runner(text: str, views: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    full = render(with_views(text, views), False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = full
        for table in used_tables(full):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(named)

    return run


def oracle(text: str, views: dict[str, str]) -> str:
    return render(with_views(text, views), True)
