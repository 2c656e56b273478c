"""Row verdicts: what every row fails, found in one scan per table and read by everything else.

A table's checks and the targets of its policies become numbered tests. One scan writes a narrow
fact per row: its primary key, the set of row rules it fails as a bit mask, and digests of the
keys that uniqueness and large foreign keys compare. Grouping these facts gives the bits that depend on
other rows. Rows with a bit set are the verdicts; a row may have several whose bits are disjoint,
so masks add up by OR. Counts, samples, target sets and rechecks read facts and verdicts, never
the table again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowwarden.contracts import COMPLETENESS, REFERENTIAL_INTEGRITY, SCHEMA_DRIFT, UNIQUENESS
from rowwarden.functions.predicates import is_missing, row_predicate, structural_error
from rowwarden.operators.digests import DIGEST, digest_columns, exact_groups, is_exact
from rowwarden.operators.joins import fits_broadcast, skew_join
from rowwarden.registry import Registry
from rowwarden.session import config_frame, packed, stored

Frames = Mapping[str, DataFrame]
BITS = 62  # tests in one word of a mask
KEY = ("key_n", "key_d", "key_s")  # a primary key as whole number, other number or text, in its own order
TEST_KEYS = ("table", "word")
GROUP = "struct<keyset:int,key_nulls:int,key_d0:bigint,key_d1:bigint>"


def key_columns(rows: DataFrame, pk: str | None) -> list[Column]:
    """``KEY`` of a row; all null without a key column."""
    kind = rows.schema[pk].dataType.typeName() if pk in rows.columns else None
    whole = kind in ("byte", "short", "integer", "long")
    number = kind in ("float", "double", "decimal")
    return [
        (F.col(pk).cast("long") if whole else F.lit(None).cast("long")).alias("key_n"),
        (F.col(pk).cast("double") if number else F.lit(None).cast("double")).alias("key_d"),
        (F.col(pk).cast("string") if kind and not whole else F.lit(None).cast("string")).alias("key_s")]


def key_text() -> Column:
    """The primary key as the text that target sets are made of."""
    return F.coalesce(F.col("key_n").cast("string"), F.col("key_s"))


@dataclass
class TableTests:
    """The tests of one table. An identity is what a test asks, so a check and a policy that ask the same
    share a bit."""

    table: str
    pk: str | None
    identities: dict[tuple, int] = field(default_factory=dict)
    keysets: dict[tuple[str, ...], int] = field(default_factory=dict)

    def add(self, identity: tuple) -> None:
        self.identities.setdefault(identity, len(self.identities))

    def place(self, identity: tuple) -> tuple[int, int]:
        """(word, mask with the test's one bit)"""
        word, bit = divmod(self.identities[identity], BITS)
        return word, 1 << bit


def check_identity(registry: Registry, check_id: str) -> tuple:
    spec = registry.check(check_id)
    if spec.dimension == COMPLETENESS:
        return ("missing", spec.column)
    if spec.dimension == UNIQUENESS:
        return ("shared", *spec.business_key)
    if spec.dimension == REFERENTIAL_INTEGRITY:
        return ("orphan", *registry.contract(spec.table).foreign_key(spec.column))
    return ("rule", check_id)


def policy_identity(registry: Registry, check_id: str, action_id: str) -> tuple:
    """What a policy's targets have in common. Actions without targets have no identity."""
    params = registry.policy_params(registry.check(check_id), action_id)
    if action_id in ("quarantine_nulls", "null_fill"):
        return ("missing", params["column"])
    if action_id == "quarantine_invalids":
        return check_identity(registry, check_id)
    if action_id == "quarantine_orphans":
        return ("orphan", params["fk_column"], params["ref_table"], params["ref_column"])
    keys = params["business_key"]
    return ("surplus", *([keys] if isinstance(keys, str) else keys))


class RowVerdicts:
    """Facts and verdicts of the tables that the given checks and policies are about.

    ``checks`` and ``policies`` have to be readable: their tables and columns exist. Tables without
    rows and rows without a key are allowed; so are repeated keys."""

    def __init__(self, registry: Registry, frames: Frames, spark: SparkSession, checks: Iterable[str] = (),
                 policies: Iterable[tuple[str, str]] = ()) -> None:
        self.registry, self.frames, self.spark = registry, frames, spark
        self.checks, self.policies = list(dict.fromkeys(checks)), list(dict.fromkeys(policies))
        self.tests: dict[str, TableTests] = {}
        for check_id in self.checks:
            self._tests_of(check_id).add(check_identity(registry, check_id))
        for check_id, action_id in self.policies:
            self._tests_of(check_id).add(policy_identity(registry, check_id, action_id))
        self._keyed: list[tuple[int, str, tuple[str, ...]]] = []  # keyset, table, columns
        self._parents: list[tuple[int, DataFrame]] = []
        parts = [self._facts_of(tests) for tests in self.tests.values()]
        self.facts = packed(reduce(DataFrame.unionByName, parts), "facts") if parts else None
        self.unclear: set[str] = set()
        self.marks = stored(self._marks(), "verdicts") if parts else None

    def _tests_of(self, check_id: str) -> TableTests:
        table = self.registry.check(check_id).table
        if table not in self.tests:
            key = self.registry.contract(table).primary_key
            pk = key[0] if len(key) == 1 and key[0] in self.frames[table].columns else None
            self.tests[table] = TableTests(table, pk)
        return self.tests[table]

    # -- the scan -------------------------------------------------------------------------

    def row_test(self, identity: tuple, rows: DataFrame) -> tuple[DataFrame, Column | None]:
        """The condition of a test a row decides alone, None for one that needs other rows. A foreign key with
        parents that fit a broadcast adds a column to ``rows``."""
        if identity[0] == "missing":
            return rows, is_missing(identity[1])
        if identity[0] == "rule":
            return rows, row_predicate(self.registry, self.registry.check(identity[1]))
        if identity[0] == "orphan":
            _, column, parent, ref = identity
            parents = self.frames[parent].select(F.col(ref).alias("parent_key"))
            if fits_broadcast(parents):
                name = f"parent_of_{len(rows.columns)}"
                known = parents.distinct().select("parent_key", F.lit(True).alias(name))
                joined = rows.join(F.broadcast(known), F.col(column) == F.col("parent_key"), "left").drop("parent_key")
                return joined, F.col(name).isNull()
        return rows, None

    def _keyset(self, tests: TableTests, columns: tuple[str, ...]) -> int:
        if columns not in tests.keysets:
            tests.keysets[columns] = len(self._keyed)
            self._keyed.append((len(self._keyed), tests.table, columns))
        return tests.keysets[columns]

    def _facts_of(self, tests: TableTests) -> DataFrame:
        source = rows = self.frames[tests.table]
        words = 1 + (len(tests.identities) - 1) // BITS
        masks: list[list[Column]] = [[F.lit(0).cast("long")] for _ in range(words)]
        for identity in tests.identities:
            rows, condition = self.row_test(identity, rows)
            if condition is not None:
                word, bit = tests.place(identity)
                masks[word].append(F.when(condition, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
            elif identity[0] == "orphan":
                _, column, parent, ref = identity
                keyset = self._keyset(tests, ("orphan", column, parent, ref))
                parents = self.frames[parent].select(F.col(ref).cast(source.schema[column].dataType).alias(column))
                self._parents.append((keyset, parents.filter(F.col(column).isNotNull())))
            else:
                self._keyset(tests, identity[1:])
        groups = [
            F.struct(F.lit(keyset).alias("keyset"), *digest_columns(names, is_exact(source, names)))
            for columns, keyset in tests.keysets.items() for names in [self._names(columns)]]
        return rows.select(
            F.lit(tests.table).alias("table"), *key_columns(source, tests.pk),
            F.array(*[reduce(lambda a, b: a.bitwiseOR(b), mask) for mask in masks]).alias("masks"),
            F.array(*groups).cast(f"array<{GROUP}>").alias("groups"))

    @staticmethod
    def _names(columns: tuple[str, ...]) -> tuple[str, ...]:
        """The columns of a keyset; one for a foreign key also names its parent."""
        return columns[1:2] if columns[0] == "orphan" else columns

    # -- bits that depend on other rows -----------------------------------------------------

    def _marks(self) -> DataFrame:
        words = self.facts.filter(F.exists("masks", lambda mask: mask != 0)).select(
            "table", *KEY, F.posexplode("masks").alias("word", "mask")).filter("mask != 0")
        nothing = [F.lit(None).cast(kind).alias(name) for kind, name in zip(("int", "int", "long", "long"), ("keyset", *DIGEST), strict=True)]
        parts = [words.select("table", "word", "mask", *KEY, *nothing)]
        if self._keyed:
            members = self.facts.select("table", *KEY, F.explode("groups").alias("g")).select("table", *KEY, "g.*")
            parts += self._shared(members) + self._orphans(members)
        return reduce(DataFrame.unionByName, parts)

    def _meanings(self, kinds: Sequence[str]) -> DataFrame:
        """The bits each keyset can set: (keyset, kind, word, mask)."""
        rows = []
        for tests in self.tests.values():
            for identity in tests.identities:
                keyset = tests.keysets.get(identity if identity[0] == "orphan" else identity[1:])
                if identity[0] in kinds and keyset is not None:
                    rows.append((keyset, identity[0], *tests.place(identity)))
        return config_frame(self.spark, rows, "keyset int, kind string, word int, mask bigint")

    def _shared(self, members: DataFrame) -> list[DataFrame]:
        """Rows whose key other rows have too."""
        compared = [(k, t, columns) for k, t, columns in self._keyed if columns[0] != "orphan"]
        if not compared:
            return []
        by = ["keyset", *DIGEST]
        members = members.filter(F.col("keyset").isin(*[k for k, _, _ in compared]))
        groups = stored(members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
        collided = self._collided([(k, t, c) for k, t, c in compared if not is_exact(self.frames[t], c)], groups)
        meanings = self._meanings(("shared", "surplus"))
        deduped = [k for k, t, columns in compared if ("surplus", *columns) in self.tests[t].identities]
        shared = (F.col("kind") == "shared") & (F.col("key_nulls") == 0)
        columns = ["table", "word", "mask", *KEY, *by]
        if collided is not None:
            groups = groups.join(F.broadcast(collided.select(*by).distinct()), by, "left_anti")
        met = skew_join(members, groups.select(*by), by, "left_semi", sizes=groups)
        if not deduped:
            parts = [met] if collided is None else [met, collided.filter("n > 1")]
            return [part.join(F.broadcast(meanings), "keyset").filter(shared).select(columns) for part in parts]
        # which row stays is only asked among rows that share a key
        met = stored(met, "members")
        kept = met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY)).alias("keep"))
        met = skew_join(met, kept.drop("n"), by, "inner", sizes=kept)
        fits = shared | ((F.col("kind") == "surplus") & (F.struct(*KEY) != F.col("keep")))
        named = ["table", *KEY, *by, "keep"]
        everyone = met.select(named)
        if collided is not None:
            everyone = everyone.unionByName(collided.filter("n > 1").select(named))
        parts = [everyone.join(F.broadcast(meanings), "keyset").filter(fits).select(columns)]
        # which row a dedupe keeps is open where a row of a group has no key of its own
        open_ = everyone.drop("keep").filter(F.col("keyset").isin(deduped)).groupBy("keyset", *KEY).agg(F.count(F.lit(1)).alias("n")).filter(
            (F.col("n") > 1) | key_text().isNull()).select("keyset").distinct()
        self.unclear = {row["keyset"] for row in open_.collect()}  # at most one per keyset
        return parts

    def _collided(self, wide: list[tuple[int, str, tuple[str, ...]]], groups: DataFrame) -> DataFrame | None:
        """Rows of digests that several keys share, each with its own key's ``n`` and ``keep``. The tables are
        read again for the keys behind digests that occur twice, and for nothing else."""
        def looked_up(keyset: int, table: str, keys: tuple[str, ...]) -> DataFrame | None:
            mine = groups.filter(F.col("keyset") == keyset).select(*DIGEST, "n")
            source = self.frames[table]
            # the key columns under names of their own: a table may use ours
            names = [f"part{n}" for n in range(len(keys))]
            rows = source.select(
                *key_columns(source, self.tests[table].pk), *[F.col(key).alias(name) for key, name in zip(keys, names, strict=True)])
            rows = rows.select("*", *digest_columns(names, False))
            exact, shared = exact_groups(rows, names, mine, F.min(F.struct(*KEY)).alias("keep"))
            if shared is None:
                return None
            mixed = exact.join(shared, list(DIGEST), "left_semi")
            few = skew_join(rows, shared, DIGEST, "left_semi", sizes=mine)
            joined = skew_join(few, mixed.select(*names, "n", "keep"), names, "inner", null_safe=True, sizes=mixed)
            return joined.select(F.lit(table).alias("table"), *KEY, F.lit(keyset).alias("keyset"), *DIGEST, "n", "keep")

        with ThreadPoolExecutor(4) as pool:  # independent jobs
            found = [rows for rows in pool.map(lambda one: looked_up(*one), wide) if rows is not None]
        return stored(reduce(DataFrame.unionByName, found), "collided_rows") if found else None

    def _orphans(self, members: DataFrame) -> list[DataFrame]:
        """Rows without a parent, for parents too many to broadcast. Values are counted before they meet them."""
        parts = []
        for keyset, parents in self._parents:
            _, table, columns = self._keyed[keyset]
            column = columns[1]
            if not is_exact(self.frames[table], [column]):
                rows = self.frames[table].select(*key_columns(self.frames[table], self.tests[table].pk), F.col(column).alias("part0"))
                known = parents.select(F.col(column).alias("part0")).distinct()
                groups = rows.groupBy("part0").agg(F.count(F.lit(1)).alias("n")).join(known, "part0", "left_anti")
                lost = skew_join(rows, groups.select("part0"), ["part0"], "left_semi", null_safe=True, sizes=groups)
                lost = lost.select(F.lit(table).alias("table"), *KEY, F.lit(keyset).alias("keyset"),
                                   F.lit(0).alias("key_nulls"), F.lit(0).cast("long").alias("key_d0"), F.lit(0).cast("long").alias("key_d1"))
            else:
                mine = members.filter(F.col("keyset") == keyset)
                known = parents.select(*digest_columns([column], True)).distinct()
                groups = mine.groupBy("keyset", *DIGEST).agg(F.count(F.lit(1)).alias("n")).join(known, list(DIGEST), "left_anti")
                lost = skew_join(mine, groups.select(*DIGEST), DIGEST, "left_semi", sizes=groups)
            parts.append(lost.join(F.broadcast(self._meanings(("orphan",))), "keyset").select(
                "table", "word", "mask", *KEY, "keyset", *DIGEST))
        return parts

    # -- readings ---------------------------------------------------------------------------

    def _asked(self, named: Iterable[tuple]) -> list[tuple]:
        """(*names, table, word, mask) of named tests, the last of each name being its identity."""
        rows = []
        for check_id, *more, identity in named:
            table = self.registry.check(check_id).table
            rows.append((check_id, *more, table, *self.tests[table].place(identity)))
        return rows

    def _checks_frame(self, check_ids: Iterable[str]) -> DataFrame:
        asked = self._asked((check_id, check_identity(self.registry, check_id)) for check_id in check_ids)
        return config_frame(self.spark, asked, "check_id string, table string, word int, bit bigint")

    def counts(self) -> DataFrame:
        """(check_id, n_failed, n_total) of every check. Verdicts are counted mask by mask first."""
        asked = self._checks_frame(self.checks)
        if not self.checks:
            return asked.select("check_id", F.lit(0).cast("long").alias("n_failed"), F.lit(0).cast("long").alias("n_total"))
        totals = self.facts.groupBy("table").agg(F.count(F.lit(1)).alias("n_total"))
        masks = self.marks.groupBy("table", "word", "mask").agg(F.count(F.lit(1)).alias("n"))
        failed = masks.join(F.broadcast(asked), list(TEST_KEYS)).filter("mask & bit != 0").groupBy("check_id").agg(F.sum("n").alias("n_failed"))
        # one row per check, or per table
        return asked.select("check_id", "table").join(failed, "check_id", "left").join(F.broadcast(totals), "table", "left").select(
            "check_id", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_total", F.lit(0)).alias("n_total"))

    def masks(self) -> DataFrame:
        """(table, failed, n_rows): how many rows fail exactly this sorted set of checks, of those that a row
        and small parents decide. Rows that pass all of them have an empty set."""
        counted = self.facts.groupBy("table", "masks").agg(F.count(F.lit(1)).alias("n_rows"))
        words = counted.select("*", F.posexplode("masks").alias("word", "mask"))
        # one group per distinct set of rules
        return words.join(F.broadcast(self._checks_frame(self.checks)), list(TEST_KEYS), "left").groupBy("table", "masks").agg(
            F.first("n_rows").alias("n_rows"),
            F.array_sort(F.collect_set(F.when(F.expr("mask & bit != 0"), F.col("check_id")))).alias("failed")).select("table", "failed", "n_rows")

    def sample_keys(self, check_ids: Sequence[str], limit: int) -> DataFrame:
        """(check_id, table, *KEY, keyset, *DIGEST): the first ``limit`` failing rows of each check by
        primary key. Tasks send on ``limit`` rows a check (the window's group limit)."""
        failed = self.marks.join(F.broadcast(self._checks_frame(check_ids)), list(TEST_KEYS)).filter("mask & bit != 0")
        first = Window.partitionBy("check_id").orderBy(*KEY)
        return failed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit).select(
            "check_id", "table", *KEY, "keyset", *DIGEST)

    def samples(self, check_ids: Sequence[str], limit: int) -> DataFrame:
        """(check_id, row_key, sample): the first failing rows as JSON, for tables with a key column.

        The keys of all samples are few, ``limit`` a check at most; they are pushed to the reader of each table,
        which is read once for all its checks."""
        wanted: dict[str, list] = {}
        for row in self.sample_keys(check_ids, limit).collect():
            wanted.setdefault(row["table"], []).append(row)
        parts = [config_frame(self.spark, [], "check_id string, row_key string, sample string")]
        for table, rows in wanted.items():
            parts.append(self._fetched(table, rows, limit))
        return reduce(DataFrame.unionByName, parts)

    def _fetched(self, table: str, keys: list, limit: int) -> DataFrame:
        """The sampled rows of one table. Where several rows hold a sampled key, those that fail are told
        apart by the test: its condition, or the digest of the compared columns."""
        pk, source = self.tests[table].pk, self.frames[table]
        named = [row for row in keys if row["key_n"] is not None or row["key_s"] is not None]
        kept = F.col(pk).isin([_typed(source, pk, row) for row in named])
        found = source.filter(kept if len(named) == len(keys) else kept | F.col(pk).isNull())
        body = F.to_json(F.struct(*[as_text(source, name) for name in source.columns]), {"ignoreNullFields": "false"})
        rows = found.select("*", F.struct(*key_columns(source, pk)).alias("sample_key"), body.alias("sample"))
        fails = F.lit(False)
        for check_id in dict.fromkeys(row["check_id"] for row in keys):
            identity = check_identity(self.registry, check_id)
            rows, condition = self.row_test(identity, rows)
            if condition is None:
                names = identity[1:2] if identity[0] == "orphan" else identity[1:]
                exact = is_exact(source, names)
                known = identity[0] == "shared" or exact
                condition = F.struct(*digest_columns(names, exact)) == F.col("sample_digest") if known else F.lit(True)
            fails = F.when(F.col("sample_check") == check_id, condition).otherwise(fails)
        wanted = config_frame(
            self.spark, list({(row["check_id"], *[tuple(row[n] for n in names) for names in (KEY, DIGEST)]) for row in keys}),
            "sample_check string, wanted_key struct<key_n:bigint,key_d:double,key_s:string>,"
            " sample_digest struct<key_nulls:int,key_d0:bigint,key_d1:bigint>")
        met = rows.join(F.broadcast(wanted), F.col("sample_key").eqNullSafe(F.col("wanted_key"))).filter(fails)
        first = Window.partitionBy("sample_check").orderBy("sample_key", "sample")
        return met.withColumn("sample_place", F.row_number().over(first)).filter(F.col("sample_place") <= limit).select(
            F.col("sample_check").alias("check_id"), F.coalesce(
                F.col("sample_key.key_n").cast("string"), F.col("sample_key.key_s"), F.lit("")).alias("row_key"), "sample")

    def targets(self, policies: Iterable[tuple[str, str]] | None = None) -> DataFrame:
        """(check_id, action_id, table, *KEY): one row per target row of each policy, for those whose targets
        are clear."""
        chosen = [p for p in (self.policies if policies is None else policies) if not self.is_unclear(*p)]
        asked = self._asked((c, a, policy_identity(self.registry, c, a)) for c, a in chosen)
        wanted = config_frame(self.spark, asked, "check_id string, action_id string, table string, word int, bit bigint")
        return self.marks.join(F.broadcast(wanted), list(TEST_KEYS)).filter("mask & bit != 0").select(
            "check_id", "action_id", "table", *KEY)

    def is_unclear(self, check_id: str, action_id: str) -> bool:
        """A dedupe over rows whose primary keys are null or repeat has no target set."""
        identity = policy_identity(self.registry, check_id, action_id)
        keysets = self.tests[self.registry.check(check_id).table].keysets
        return identity[0] == "surplus" and keysets.get(identity[1:]) in self.unclear


def _typed(source: DataFrame, pk: str, row) -> Column:
    value = row["key_n"] if row["key_n"] is not None else row["key_s"]
    return F.lit(value).cast(source.schema[pk].dataType)


def as_text(rows: DataFrame, name: str) -> Column:
    """A value as samples show it: times as text."""
    temporal = rows.schema[name].dataType.typeName() in {"date", "timestamp", "timestamp_ntz", "interval", "daytimeinterval"}
    return F.col(name).cast("string").alias(name) if temporal else F.col(name)


def readable_checks(registry: Registry, frames: Frames) -> list[str]:
    """Declared checks that rows decide and whose columns exist."""
    seen = {table: frame.columns for table, frame in frames.items()}
    return [spec.check_id for spec in registry.checks.values()
            if spec.dimension != SCHEMA_DRIFT and structural_error(registry, spec, seen) is None]
