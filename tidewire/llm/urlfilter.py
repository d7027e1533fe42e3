"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 holds the listed keys, level 2 those other keys of the corpus that level 1 takes for listed, level 3 the
listed keys that level 2 takes for others, and so on until no error is left. Over the keys that the corpus can
ask for, the cascade then answers exactly, and no url is joined with a list.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import store

BITS_PER_KEY = 12
PROBES = 5
MAX_BITS = 1 << 22  # of one level of one part: half a megabyte in the plan
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    words: str  # 64-bit words, comma-separated

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to a literal by the optimizer
        hit = None
        for probe in range(PROBES):
            at = _position(key, self.number, probe, self.bits)
            bit = F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
            hit = bit if hit is None else hit & bit
        return hit


def _position(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 100 + probe), key), F.lit(bits).cast("bigint"))


@dataclass(frozen=True)
class Cascade:
    """Levels for each part; a key belongs to the part that its hash names."""

    parts: tuple[tuple[Level, ...], ...]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        def answer(levels: tuple[Level, ...]) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for level in reversed(levels):
                out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 0))
            return out

        if len(self.parts) == 1:
            return answer(self.parts[0])
        out = F.lit(False)
        for n, levels in enumerate(self.parts):
            out = F.when(_part(key, len(self.parts)) == n, answer(levels)).otherwise(out)
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts).cast("bigint"))


def _level(keys: DataFrame, number: int, count: int) -> Level:
    """A Bloom filter of ``count`` keys. The driver sees its words only, never more than it has bits for."""
    bits = 64
    while bits < BITS_PER_KEY * count:
        bits *= 2
    spots = keys.select(F.explode(F.array(*[_position(F.col("key"), number, p, bits) for p in range(PROBES)])).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    dense = [0] * (bits // 64)
    for row in words.collect():
        dense[row.word] = row.bits
    return Level(number, bits, ",".join(map(str, dense)))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """A cascade that is exact for every ``key`` of ``universe``. Null keys are neither listed nor asked for.

    A list that one level of ``max_bits`` cannot hold is split by a hash of the key, each part with its own levels.
    Both sides shrink at every level by the filter's error rate; what is left is written to the shared folder.
    """
    listed = store(listed.select("key").filter("key is not null").distinct(), "listed")
    others = store(universe.select("key").filter("key is not null").distinct().join(listed, "key", "left_anti"), "others")
    parts = max(1, -(-listed.count() * BITS_PER_KEY // max_bits))
    built = []
    for n in range(parts):
        mine, rest = (d if parts == 1 else d.filter(_part(F.col("key"), parts) == n) for d in (listed, others))
        levels: list[Level] = []
        count = mine.count()
        while count:
            levels.append(_level(mine, len(levels) + 1, count))
            mine, rest = store(rest.filter(levels[-1].has(F.col("key"))), "mistaken"), mine
            count = mine.count()
        built.append(tuple(levels))
    return Cascade(tuple(built))


def suffixes(host: Column, labels: int) -> Column:
    """The host and its parent domains of at most ``labels`` labels, shortest first."""
    parts = F.split(host, r"\.")
    last = F.slice(parts, -F.least(F.size(parts), F.lit(labels)), labels)
    return F.transform(F.sequence(F.lit(1), F.size(last)), lambda n: F.array_join(F.slice(last, -n, n), "."))


def prefixes(path: Column, depth: int) -> Column:
    """The first ``depth`` prefixes of the path that end with a slash."""
    parts = F.split(F.substring_index(path, "/", depth + 1), "/")
    ends = F.size(F.split(path, "/", depth + 2)) - 1
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda n: F.when(
        n <= ends, F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))), lambda p: p.isNotNull())


def candidate_keys(host: Column, path: Column, kinds: list[str], labels: int, depth: int, host_labels: int) -> Column:
    """All keys a url can ask for: ``kind host/path`` for each rule kind, ``listed host`` for the host list."""
    rules = F.flatten(F.transform(suffixes(host, labels), lambda h: F.flatten(F.transform(
        prefixes(path, depth), lambda p: F.array(*[F.concat(F.lit(f"{k} "), h, p) for k in kinds])))))
    return F.concat(rules, F.transform(suffixes(host, host_labels), lambda h: F.concat(F.lit("listed "), h)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed_hosts: DataFrame,
               id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` are (block or allow, host, path starting and ending with a slash). A rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest fitting rule wins, of equally long ones the
    first in order of text. Without a rule, a host on ``listed_hosts`` (column host), or below one, is blocked and
    any other allowed. A null or malformed url has empty host and path, fits nothing and is allowed. Repeated rows
    are kept. Only as many labels and path parts are looked at as the longest rule or list entry has.
    """
    for kind, host, path in rules:
        if kind not in ("block", "allow") or not host or not path.startswith("/") or not path.endswith("/"):
            raise ValueError(f"not a rule: {(kind, host, path)}")
    spark = pages.sparkSession
    kinds = ["allow", "block"]
    labels = max([h.count(".") + 1 for _, h, _ in rules], default=1)
    depth = max([p.count("/") for _, _, p in rules], default=1)
    hosts = store(listed_hosts.select(F.translate("host", UPPER, LOWER).alias("host")).filter("host != ''").distinct(), "hosts")
    host_labels = hosts.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), kinds, labels, depth, host_labels)
    universe = parsed.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    entries = spark.createDataFrame([(f"{k} {h}{p}",) for k, h, p in rules], "key string").unionByName(
        hosts.select(F.concat(F.lit("listed "), "host").alias("key")))
    cascade = build_cascade(entries, universe, max_bits)
    found = parsed.withColumn("found", F.filter(keys, cascade.has))
    fitting = F.filter("found", lambda k: ~k.startswith("listed "))
    # Kinds are equally long, so the longest key has the longest rule.
    best = F.array_min(F.transform(fitting, lambda k: F.struct((-F.length(k)).alias("n"), F.substr(k, F.lit(7)).alias("rule"), k.alias("key"))))
    return (found.withColumn("best", best).select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.key").isNotNull(), F.split("best.key", " ")[0])
        .when(F.size("found") > 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))
