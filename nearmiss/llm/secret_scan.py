"""Secret scans by multipart credential linking, with DataFrame functions alone.

A text is searched for parts of credentials, each with a role: identifiers (access keys, logins), secrets (assigned
values, long hexadecimal runs, mixed tokens) and endpoints (addresses, hosts). The three base kinds are reported
wherever they stand. The other kinds are weak: alone they are mostly harmless, so an interval join within a scope
decides on them. A scope is a stretch of text without an empty line; two parts meet if they lie in one scope and
start at most REACH code points apart. An identifier is reported if it meets a secret, a secret if it meets an
identifier, an endpoint if it meets both. Base parts take part in the join.

The join never pairs parts. The parts of a role that start in one block of REACH code points are first reduced to
their first and last start; a part then meets at most three such rows a role. Only places shuffle, keyed by a stored
row number, scope and block, and only those of documents with a weak part; texts stay where they are read.

Null counts as empty and an empty text has no parts; very long texts are searched whole; overlapping parts of
different kinds are all kept, in order of start, then kind; repeated rows and null ids each give their own row. An
empty table gives no rows; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents

#: Code points between the starts of two parts that still belong together.
REACH = 256
#: Elements summed one by one before whole blocks are summed.
BLOCK = 128
SPANS = "array<struct<start:int,kind:int,end:int>>"


def either_case(words: str) -> str:
    """The pattern with every ASCII letter in either case, without a flag that folds other letters too."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def assigned(words: str, value: str) -> str:
    return f"({either_case(words)})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


@dataclass(frozen=True)
class Kind:
    """A kind of part. group and least: the shortest value of a match; also: patterns the whole match must hold,
    not: one it must not hold. Patterns mean the same to Java and to RE2."""

    name: str
    role: str
    pattern: str
    weak: bool = True
    group: int = 0
    least: int = 1
    also: tuple[str, ...] = ()
    never: str | None = None


#: Base kinds first, in the order of the contract. A run of 24 or more is the same as a whole run that is long enough.
KINDS = (
    Kind("assign", "secret", assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), False, 2, 6),
    Kind("access", "identifier", "AKIA[A-Z0-9]{16,}", False),
    Kind("hex", "secret", "[0-9a-f]{24,}", False),
    Kind("login", "identifier", assigned("user_?name|user|login|client_?id|account", "[A-Za-z0-9@._+-]+"), True, 2, 3),
    Kind("key_id", "identifier", "(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}", never="^AKIA[A-Z0-9]{16}"),
    Kind("phrase", "secret", assigned("passphrase|pass|pwd|credential|private_?key", "[^\\x20\\x09-\\x0D\"'<>]+"), True, 2, 4),
    Kind("mixed", "secret", "[A-Za-z0-9+/_=-]{20,}", also=("[a-z]", "[A-Z]", "[0-9]")),
    Kind("address", "endpoint", "(?:https?|ftp|ssh|amqp|redis|mysql|mongodb|postgres|postgresql)://[^\\x20\\x09-\\x0D\"'<>]+"),
    Kind("host", "endpoint", assigned("host_?name|host|server|endpoint|base_?url", "[A-Za-z0-9._:/-]+"), True, 2, 4),
)
#: An empty line ends a scope.
BREAK = "\\n[\\x20\\x09\\x0D]*\\n"
#: Roles that a weak part must meet.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
ROLE_BITS = {"identifier": 1, "secret": 2, "endpoint": 4}


def sums_before(values: str) -> Column:
    """For every element of a column the sum of those before it; an array grows by copying, so blocks are summed first."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def running(array: Column) -> Column:
        begin = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(array, begin, lambda a, x: F.struct((a["total"] + x).alias("total"),
                                                               F.array_append(a["sums"], a["total"]).alias("sums")))

    inside = F.transform(blocks, running)
    return F.flatten(F.flatten(F.transform(F.array(inside), lambda rows: F.zip_with(
        rows, running(F.transform(rows, lambda r: r["total"]))["sums"],
        lambda r, before: F.transform(r["sums"], lambda s: s + before)))))


def with_places(rows: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds `name`: an array of (start, end, hit, value) of the matches, in code points, null without a match. The
    text between matches gives their places."""
    text = F.col("text")
    seen = F.rlike(text, F.lit(pattern))
    rows = rows.withColumns({
        "hit": F.when(seen, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        "value": F.when(seen, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))),
        "gap": F.when(seen, F.split(text, pattern, -1))})
    rows = rows.withColumn("parts", F.zip_with(
        F.slice("gap", F.lit(1), F.size("hit")), F.arrays_zip("hit", "value"),
        lambda g, h: F.struct(F.length(g).alias("skip"), F.length(h["hit"]).alias("size"), h["hit"].alias("hit"),
                              h["value"].alias("value"))))
    rows = rows.withColumn("steps", F.transform("parts", lambda p: p["skip"] + p["size"]))
    rows = rows.withColumn("before", F.when(F.col("steps").isNotNull(), sums_before("steps")))
    return rows.withColumn(name, F.zip_with("parts", "before", lambda p, b: F.struct(
        (b + p["skip"]).alias("start"), (b + p["skip"] + p["size"]).alias("end"), p["hit"].alias("hit"),
        p["value"].alias("value")))).drop("hit", "value", "gap", "parts", "steps", "before")


def spans_of(number: int, kind: Kind) -> Column:
    def good(p: Column) -> Column:
        test = F.length(p["value"]) >= kind.least
        for pattern in kind.also:
            test = test & F.rlike(p["hit"], F.lit(pattern))
        return test & ~F.rlike(p["hit"], F.lit(kind.never)) if kind.never else test

    spans = F.transform(F.filter(kind.name, good), lambda p: F.struct(
        p["start"].alias("start"), F.lit(number).alias("kind"), p["end"].alias("end")))
    return F.coalesce(spans, F.array().cast(SPANS))


def find_parts(docs: DataFrame) -> DataFrame:
    """number, doc_id, base and weak (arrays of start, kind, end), breaks (starts of empty lines, where a part is weak)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for number, kind in enumerate(KINDS):
        rows = with_places(rows, kind.name, kind.pattern, kind.group)
        rows = rows.withColumn(kind.name, spans_of(number, kind))
    rows = rows.withColumns({
        "base": F.concat(*(k.name for k in KINDS if not k.weak)),
        "weak": F.concat(*(k.name for k in KINDS if k.weak))}).drop(*(k.name for k in KINDS))
    rows = with_places(rows.withColumn("text", F.when(F.size("weak") > 0, F.col("text"))), "breaks", BREAK)
    return rows.select(F.monotonically_increasing_id().alias("number"), "doc_id", F.array_sort("base").alias("base"), "weak",
                       F.transform("breaks", lambda b: b["start"]).alias("breaks"))


def linked_parts(found: DataFrame) -> DataFrame:
    """number and added: the weak parts of a document that meet what they need."""
    ends = F.transform(F.coalesce("breaks", F.array().cast("array<int>")), lambda s: F.struct(
        s.alias("start"), F.lit(-1).alias("kind"), s.alias("end")))
    parts = found.select("number", F.explode(F.concat("base", "weak", ends)).alias("p")).select("number", "p.*")
    order = Window.partitionBy("number").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    roles = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE_BITS[k.role])))
    parts = (parts.withColumn("scope", F.sum((F.col("kind") < 0).cast("int")).over(order)).where("kind >= 0")
             .withColumns({"role": roles[F.col("kind")], "block": F.floor(F.col("start") / REACH)}))
    near = (parts.groupBy("number", "scope", "block", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
            .select("number", "scope", F.explode(F.array(*(F.col("block") + d for d in (-1, 0, 1)))).alias("block"),
                    F.col("role").alias("met"), "first", "last"))
    weak = parts.where(F.col("kind").isin([i for i, k in enumerate(KINDS) if k.weak]))
    met = (weak.join(near, ["number", "scope", "block"])
           .where((F.col("last") >= F.col("start") - REACH) & (F.col("first") <= F.col("start") + REACH))
           .groupBy("number", "start", "kind", "end", "role").agg(F.bit_or("met").alias("met")))
    needs = F.lit(False)
    for role, others in NEEDS.items():
        bits = sum(ROLE_BITS[o] for o in others)
        needs = needs | ((F.col("role") == ROLE_BITS[role]) & (F.col("met").bitwiseAND(F.lit(bits)) == bits))
    return met.where(needs).groupBy("number").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: sorted arrays of (start, kind, end), kind a place in KINDS; one row per document."""
    # numbers are stored with the places: a later read may split the table anew
    found = cut_lineage(find_parts(docs), "credential_parts")
    plain = found.where(F.size("weak") == 0).select("doc_id", "base", F.array().cast(SPANS).alias("added"))
    doubtful = found.where(F.size("weak") > 0)
    linked = doubtful.join(linked_parts(doubtful), "number", "left").select(
        "doc_id", "base", F.array_sort(F.coalesce("added", F.array().cast(SPANS))).alias("added"))
    return plain.unionByName(linked)


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(documents(spark, sf_dir))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if not k.weak]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def check_sql() -> str:
    """The same in DuckDB, with the parts as rows and each weak part compared with those around it."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def matches(number: int, pattern: str, group: int, test: str) -> str:
        p = quoted(pattern)
        return f"""SELECT number, {number} AS kind, start, start + size AS "end" FROM (
  SELECT number, u.hit, u.value, length(u.hit) AS size, sum(length(u.gap) + length(u.hit)) OVER
         (PARTITION BY number ORDER BY u.i) - length(u.hit) AS start
  FROM (SELECT number, unnest(list_transform(hits, lambda h, i: {{'i': i, 'hit': h, 'value': vals[i], 'gap': gaps[i]}})) AS u
    FROM (SELECT number, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals,
                 string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p})))) WHERE {test}"""

    def test(kind: Kind) -> str:
        every = [f"length(value) >= {kind.least}", *(f"regexp_matches(hit, {quoted(a)})" for a in kind.also)]
        return " AND ".join(every + ([f"NOT regexp_matches(hit, {quoted(kind.never)})"] if kind.never else []))

    found = "\nUNION ALL ".join(matches(i, k.pattern, k.group, test(k)) for i, k in enumerate(KINDS))
    roles = ", ".join(f"({i}, '{k.name}', '{k.role}', {str(k.weak).lower()})" for i, k in enumerate(KINDS))
    meets = " OR ".join(f"(a.role = '{r}' AND " + " AND ".join(f"bool_or(b.role = '{o}')" for o in others) + ")"
                        for r, others in NEEDS.items())
    counts = ", ".join(f"count(kind) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(KINDS) if not k.weak)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS number, doc_id, coalesce(text, '') AS text FROM documents),
breaks AS MATERIALIZED ({matches(-1, BREAK, 0, 'true')}),
kinds(kind, name, role, weak) AS (VALUES {roles}),
parts AS MATERIALIZED (
  SELECT p.*, name, role, weak,
         (SELECT count(*) FROM breaks b WHERE b.number = p.number AND b.start < p.start) AS scope
  FROM ({found}) p JOIN kinds USING (kind)),
added AS (
  SELECT a.number, a.kind, a.start, a."end", a.name FROM parts a
  JOIN parts b ON a.number = b.number AND a.scope = b.scope AND abs(a.start - b.start) <= {REACH}
  WHERE a.weak GROUP BY a.number, a.kind, a.start, a."end", a.name, a.role HAVING {meets}),
spans AS (
  SELECT number, kind, start, name || ':' || start::BIGINT || ':' || "end"::BIGINT AS span, true AS base FROM parts WHERE NOT weak
  UNION ALL SELECT number, kind, start, name || ':' || start::BIGINT || ':' || "end"::BIGINT, false FROM added)
SELECT doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans USING (number) GROUP BY number, doc_id
"""


OP11_SQL = check_sql()
