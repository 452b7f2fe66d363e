"""Column helpers: rounding, keys, paths, globs, line counts. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounds on the binary value, ties toward plus infinity; Spark's round() would first go through a decimal."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons; null if a part is null."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat(*[x for c in cols for x in (F.lit(":"), c)][1:]), 256)


def normalized(path: Column) -> Column:
    """Slashes for backslashes, one for several."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    """The POSIX directory: `.` for a bare name."""
    return F.when(~path.contains("/"), F.lit(".")).when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def extension(path: Column) -> Column:
    """From the last dot of the name, which must not begin with it."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def without_source_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[cm]?[jt]sx?$", "")


def join_path(directory: Column, spec: Column) -> Column:
    """directory/spec with `.` and `..` resolved; a `..` above the top stays; the empty path is `.`."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when((part == "") | (part == "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.concat_ws("/", directory, spec), "/", -1)
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(folded == "", F.lit(".")).otherwise(folded)


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def physical_lines(text: Column) -> Column:
    """Line feeds plus one."""
    return F.size(F.split(text, "\n", -1))


def logical_lines(text: Column) -> Column:
    """Lines that aren't blank and don't start a comment."""
    return F.size(F.filter(lines(text), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(//|/\*|\*)")))


def route_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/", -1), lambda x: x != ""))


def parent_steps(spec: Column) -> Column:
    """How often `../` stands in an import."""
    return F.size(F.split(spec, r"\.\./", -1)) - 1


def nesting_depth(text: Column) -> Column:
    """The deepest nesting of markup tags: opening tags count up, closing ones down, self-closing ones for themselves."""
    tags = F.regexp_extract_all(text, F.lit(r"</?[A-Za-z][^<>]*>|</?>"), F.lit(0))
    change = lambda t: F.when(t.startswith("</"), F.lit(-1)).when(t.endswith("/>"), F.lit(0)).otherwise(F.lit(1))
    seed = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = F.aggregate(tags, seed, lambda a, t: F.struct((a["now"] + change(t)).alias("now"), F.greatest(a["most"], a["now"] + F.when(t.endswith("/>"), F.lit(1)).otherwise(change(t))).alias("most")))
    return walk["most"]


def ignore_glob(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression: it may begin at any directory; ? is no wildcard."""
    said = re.sub("/+", "/", pattern.replace("\\", "/")).removeprefix("/")
    return f"(^|.*/){_stars(said)}$"


def policy_glob(pattern: str) -> str:
    """A policy's pattern as a regular expression over the whole path; ? stays what it is in one."""
    said = pattern.replace("\\", "/").removeprefix("./")
    return f"^{_stars(said, plain='?')}$"


def _stars(said: str, plain: str = "") -> str:
    out, i = [], 0
    while i < len(said):
        if said.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = said[i]
        out.append("[^/]*" if c == "*" else c if c in plain else re.sub(r"([|\\{}()\[\]^$+?.])", r"\\\1", c))
        i += 1
    return "".join(out)
