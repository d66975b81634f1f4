"""Parsing and rewriting of log lines, paths and image names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the replacements matters.
MASKS = [(r"0x[0-9a-fA-F]+", "X"), (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "IP"), (r"[0-9.]{5,}", "N")]
_POD = r"/var/log/pods/([^/]+/[^/]+)/[^/]+\.log$"


def capture(line: Column, pattern: str, otherwise: Column | None = None) -> Column:
    """The first group where the pattern is found, else ``otherwise`` (null)."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(F.lit(None) if otherwise is None else otherwise)


def masked(line: Column) -> Column:
    """The line with hex numbers, addresses and long numbers replaced by marks."""
    for pattern, mark in MASKS:
        line = F.regexp_replace(line, pattern, mark)
    return line


def fingerprint(line: Column, pattern: str, width: int = 70) -> Column:
    """A message's masked capture, or its masked beginning."""
    return masked(capture(line, pattern, F.substring(line, 1, width)))


def cri(raw: Column) -> Column:
    """``time, stream, flag, message`` of a container runtime's line; null if it is none. The line is split once."""
    def parsed(p: Column) -> Column:
        good = (F.size(p) == 4) & (p[0] != "") & p[1].isin("stdout", "stderr") & p[2].isin("F", "P")
        return F.when(good, F.struct(p[0].alias("time"), p[1].alias("stream"), p[2].alias("flag"), p[3].alias("message")))

    return F.transform(F.array(F.split(raw, " ", 4)), parsed)[0]


def pod_path(path: Column) -> Column:
    """``namespace, pod, uid, container`` of a pod log's path; null if it is none."""
    def parsed(p: Column) -> Column:
        good = (F.size(p) == 4) & ~F.exists(p, lambda x: x == "")
        return F.when(good, F.struct(p[0].alias("namespace"), p[1].alias("pod"), p[2].alias("uid"), p[3].alias("container")))

    # ns_pod_uid/container: the uid may hold underscores
    both = F.split(F.regexp_extract(path, _POD, 1), "/")
    return F.transform(F.array(F.concat(F.split(both[0], "_", 3), F.slice(both, 2, 1))), parsed)[0]


def image_name(image: Column, registry: str, project: str) -> Column:
    """The image in ``registry/project`` by the last segment of its name, without digest; one that is there already stays."""
    plain = F.substring_index(image, "@sha256:", 1)
    home = f"{registry}/{project}/"
    return F.when(plain.startswith(home), plain).otherwise(F.concat(F.lit(home), F.element_at(F.split(plain, "/"), -1)))


def yaml_scalar(text: Column) -> Column:
    """A scalar in single quotes if it needs them."""
    return F.when(text.rlike(r"[ :#{}\[\],&*!|>'\"%@`]") | (text == ""), F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(text)


def found(line: Column, pattern: str) -> Column:
    """All that a pattern finds first, whichever of its alternatives and groups; empty if it finds nothing."""
    return F.regexp_extract(line, pattern, 0)


def nth(line: Column, n: int) -> Column:
    """The n-th field between blanks and tabs, from 1, as column-wise text tools count; empty if there are fewer."""
    return F.coalesce(F.get(F.filter(F.split(line, r"[ \t]+"), lambda x: x != ""), F.lit(n - 1)), F.lit(""))


def port_bindings(bindings: Column) -> Column:
    """``host:container[/protocol]`` of a map from ``port/protocol`` to a list of ``{HostPort}``, sorted, each once; tcp isn't named.
    Ports that no host port leads to are left out."""

    def one(e: Column) -> Column:
        protocol = F.when(F.contains(e["key"], F.lit("/")), F.substring_index(e["key"], "/", -1)).otherwise("tcp")
        end = F.concat(F.lit(":"), F.substring_index(e["key"], "/", 1), F.when(protocol == "tcp", "").otherwise(F.concat(F.lit("/"), protocol)))
        hosts = F.filter(F.transform(e["value"], lambda b: b["HostPort"]), lambda h: F.coalesce(h, F.lit("")) != "")
        return F.transform(F.coalesce(hosts, F.array().cast("array<string>")), lambda h: F.concat(h, end))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(bindings), one))))


def variables(env: Column, without: list[str]) -> Column:
    """The ``name=value`` entries of a list but those of these names, sorted; none of a null list."""
    kept = F.filter(env, lambda e: ~F.substring_index(e, "=", 1).isin(without))
    return F.array_sort(F.coalesce(kept, F.array().cast("array<string>")))


def images(manifest: Column) -> Column:
    """The image names in a rendered manifest, without quotes; those that begin with ``$`` are templates and left out."""
    named = F.transform(F.regexp_extract_all(manifest, F.lit(r"image: ([^ \n]+)"), 1), lambda x: F.replace(x, F.lit('"'), F.lit("")))
    return F.filter(named, lambda x: (x != "") & ~x.startswith("$"))


def error_key(line: Column) -> Column:
    """What a resolver's error line is counted under: the name after the number of errors, else ``.`` for the root's lines, else the
    line's beginning; long numbers masked."""
    key = capture(line, r"errors: \d+ ([^:]{0,40}):", F.when(F.contains(line, F.lit(". NS:")), ".").otherwise(F.substring(line, 1, 50)))
    return F.regexp_replace(key, r"[\d.]{5,}", "N")


def disk_benchmark(text: Column) -> Column:
    """``iops, p999, verdict`` of a disk benchmark's text: writes a second, the 99.90th percentile told within six lines after the
    sync section's name, and PASS for at least 1000 and at most 50; a missing value fails."""
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    iops, p999 = first(r"write: IOPS=([0-9.]+)"), first(r"fdatasync[^\n]*?(?:\n[^\n]*?){0,6}?99\.90th=([0-9.]+)")
    good = (F.coalesce(iops, F.lit(0.0)) >= 1000) & (F.coalesce(p999, F.lit(999.0)) <= 50)
    return F.struct(iops.alias("iops"), p999.alias("p999"), F.when(good, "PASS").otherwise("FAIL").alias("verdict"))


def image_home(registry: Column, repository: Column, host: str, project: str) -> Column:
    """``registry, repository`` that point to ``host/project`` by the repository's last segment; where a registry is given it gets
    the host, else the repository does. One that names the host already, or has no name, stays."""
    name = F.element_at(F.split(F.rtrim(repository, F.lit("/")), "/"), -1)
    moves = F.coalesce((name != "") & ~F.contains(repository, F.lit(host)), F.lit(False))
    home = F.concat(F.lit(f"{project}/"), name)
    there = F.when(registry.isNull(), F.concat(F.lit(f"{host}/"), home)).otherwise(home)
    return F.struct(F.when(moves & registry.isNotNull(), F.lit(host)).otherwise(registry).alias("registry"), F.when(moves, there).otherwise(repository).alias("repository"))


def since(at: Column, now: int, unit: int, missing: float | None = None) -> Column:
    """How many units of microseconds ago ``at``, in microseconds, was; ``missing`` for null."""
    return F.coalesce((F.lit(now) - at) / unit, F.lit(missing).cast("double"))
