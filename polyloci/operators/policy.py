"""Data-use decisions, fingerprints and content manifests."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.lineage import cut
from ..functions.ranks import rank_within

# Permission, purpose and modifier codes of the public Data Use Ontology.
UNRESTRICTED, GENERAL, HEALTH, DISEASE, POPULATION = "DUO:0000004", "DUO:0000042", "DUO:0000006", "DUO:0000007", "DUO:0000011"
NO_METHODS, RESEARCH_TYPE, NON_COMMERCIAL, NON_PROFIT_ONLY = "DUO:0000015", "DUO:0000012", "DUO:0000046", "DUO:0000045"
NON_PROFIT_NON_COMMERCIAL, PUBLICATION, COLLABORATION, ETHICS = "DUO:0000018", "DUO:0000019", "DUO:0000020", "DUO:0000021"
GEOGRAPHY, MORATORIUM, TIME_LIMIT, USER, PROJECT, INSTITUTION = "DUO:0000022", "DUO:0000024", "DUO:0000025", "DUO:0000026", "DUO:0000027", "DUO:0000028"
RETURN, GENETIC_ONLY, CLINICAL_CARE, NO_ANCESTRY = "DUO:0000029", "DUO:0000016", "DUO:0000043", "DUO:0000044"
METHODS, GENETIC = "DUO:0000031", "DUO:0000038"
BIOMEDICAL = ["DUO:0000037", "DUO:0000038", "DUO:0000039", "DUO:0000040"]
ANCESTRY = ["DUO:0000032", "DUO:0000033"]
#: What a request has to attest to under a modifier, and the field that a modifier's values are compared with.
ATTESTED = {NON_COMMERCIAL: ["non_commercial"], NON_PROFIT_ONLY: ["not_for_profit_organisation"], NON_PROFIT_NON_COMMERCIAL: ["non_commercial", "not_for_profit_organisation"], PUBLICATION: ["publication_agreed"], COLLABORATION: ["collaboration_agreed"], MORATORIUM: ["moratorium_accepted"], RETURN: ["return_to_resource_agreed"]}
COMPARED = {GEOGRAPHY: "geography", USER: "requester", PROJECT: "project", INSTITUTION: "institution"}

PERMITTED, UNDETERMINED, DENIED = 0, 1, 2
#: Requests are broadcast up to so many rows.
SMALL = 10_000
#: Lines or digests that are hashed as one.
FAN = 4096
#: Lines of a longer group that flow through its hash as one row.
FLOW = 64


def _list(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast("array<string>"))


def _plain(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))))


def _values(c: Column) -> Column:
    """The values that aren't blank, in lower case."""
    return F.filter(F.transform(_list(c), _plain), lambda x: x != "")


def _or_denied(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), PERMITTED).otherwise(DENIED)


def _all_in(purposes: Column, codes: list[str]) -> Column:
    """There is a purpose, and each is one of the codes."""
    return (F.size(purposes) > 0) & F.forall(purposes, lambda p: p.isin(codes))


def _permission_level() -> Column:
    purposes, code, disease = _list("purposes"), F.trim("permission"), _plain("disease")
    return (
        F.when(code.isin(UNRESTRICTED, GENERAL), PERMITTED)
        .when(code == HEALTH, _or_denied(_all_in(purposes, BIOMEDICAL)))
        .when(code == DISEASE, _or_denied((disease != "") & F.array_contains(_values(F.col("permission_value")), disease)))
        .when(code == POPULATION, _or_denied(_all_in(purposes, ANCESTRY)))
        .otherwise(DENIED)
    )


def _modifier_level(m: Column, as_of: str) -> Column:
    """The outcome of one modifier, a struct of id and value. One that nobody wrote a rule for is undetermined."""
    purposes, code, v = _list("purposes"), F.trim(m["id"]), _values(m["value"])
    limit = F.element_at(F.filter(F.transform(_list(m["value"]), lambda x: F.trim(x)), lambda x: x != ""), 1)
    until = F.when(limit.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(limit))
    level = F.when(code == NO_METHODS, _or_denied(~F.array_contains(purposes, METHODS)))
    level = level.when(code == GENETIC_ONLY, _or_denied(_all_in(purposes, [GENETIC])))
    level = level.when(code == NO_ANCESTRY, _or_denied(~F.exists(purposes, lambda p: p.isin(ANCESTRY))))
    level = level.when(code == ETHICS, _or_denied(_plain("ethics_approval") != ""))
    for k, flags in ATTESTED.items():
        level = level.when(code == k, _or_denied(F.least(*[F.coalesce(f, F.lit(False)) for f in [*flags, *flags]])))
    for k, field in COMPARED.items():
        level = level.when(code == k, F.when(F.size(v) == 0, UNDETERMINED).otherwise(_or_denied(F.array_contains(v, _plain(field)))))
    level = level.when(code == TIME_LIMIT, F.when((F.size(v) == 0) | until.isNull(), UNDETERMINED).otherwise(_or_denied(until >= F.to_date(F.lit(as_of)))))
    level = level.when(code == CLINICAL_CARE, PERMITTED).otherwise(UNDETERMINED)
    said = F.coalesce(F.array_contains(_list("acknowledged"), code), F.lit(False))
    return F.when((level == UNDETERMINED) & said, PERMITTED).otherwise(level)


#: Distinct rules times requests that are judged once and broadcast.
CELLS = 200_000


def _rule_key(m: Column) -> Column:
    return F.to_json(F.struct(F.trim(m["id"]).alias("i"), m["value"].alias("v")), {"ignoreNullFields": "false"})


def evaluate_data_use(profiles: DataFrame, requests: DataFrame, as_of: str, cells: int = CELLS) -> DataFrame:
    """K1: every dataset against every request: decision (permitted, denied, undetermined) and sorted reasons.

    profiles: dataset_id, permission, permission_value, modifiers array<struct<id, value>>. requests: request_id, disease,
    geography, requester, project, institution, ethics_approval, purposes, acknowledged and the flags. The worst rule
    decides. What a request leaves out counts against it; a restriction that can't be checked, or has no rule, is
    undetermined, and only that can be acknowledged. Requests are a stated query set. Each distinct rule is judged once for a
    request, and datasets look their rules up in this table; only if it were too large to be broadcast are rules judged
    within the row of a dataset and a request. Nothing is shuffled but distinct rules.
    """
    requests = requests.withColumn("__at", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("request_id")))  # a stated set
    n = requests.count()
    few = (lambda df: F.broadcast(df)) if n <= SMALL else (lambda df: df)
    permission = F.struct(F.col("permission").alias("id"), F.col("permission_value").alias("value"))
    first = F.coalesce(F.trim("permission"), F.lit("(none)"))
    name = lambda level: F.when(level == DENIED, "denied").when(level == UNDETERMINED, "undetermined").otherwise("permitted")

    def decided(x: DataFrame) -> DataFrame:
        """From (dataset_id, request_id, rules array<struct<rule, level>>)."""
        against = F.transform(F.filter("rules", lambda r: r["level"] > PERMITTED), lambda r: F.concat_ws(" ", r["rule"], name(r["level"])))
        return x.select("dataset_id", "request_id", name(F.array_max(F.col("rules")["level"])).alias("decision"), F.array_join(F.array_sort(F.array_distinct(against)), "; ").alias("reasons"))

    rule = lambda code, level: F.struct(code.alias("rule"), level.alias("level"))
    permissions = profiles.select("permission", "permission_value", F.concat(F.lit("p"), _rule_key(permission)).alias("__key")).dropDuplicates(["__key"])
    modifiers = profiles.select(F.explode("modifiers").alias("m")).select("m", F.concat(F.lit("m"), _rule_key(F.col("m"))).alias("__key")).dropDuplicates(["__key"])
    permissions, modifiers = cut(permissions), cut(modifiers)
    if (permissions.count() + modifiers.count()) * n <= cells:
        judged = permissions.crossJoin(few(requests)).select("__key", "__at", _permission_level().alias("level"))
        judged = judged.unionByName(modifiers.crossJoin(few(requests)).select("__key", "__at", _modifier_level(F.col("m"), as_of).alias("level")))
        rows = judged.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__at", "level"))).alias("a")).select("__key", F.col("a")["level"].alias("levels"))
        look_up = rows.agg(F.map_from_entries(F.collect_list(F.struct("__key", "levels"))).alias("__table"))  # one row
        keys = F.concat(F.array(F.concat(F.lit("p"), _rule_key(permission))), F.transform(F.coalesce("modifiers", F.lit([]).cast(profiles.schema["modifiers"].dataType)), lambda m: F.concat(F.lit("m"), _rule_key(m))))
        names = F.concat(F.array(first), F.coalesce(F.transform("modifiers", lambda m: F.trim(m["id"])), F.array().cast("array<string>")))
        own = profiles.crossJoin(F.broadcast(look_up)).select("dataset_id", F.arrays_zip(names.alias("rule"), F.transform(keys, lambda k: F.element_at("__table", k)).alias("levels")).alias("__own"))
        pairs = own.crossJoin(few(requests.select("request_id", "__at")))
        return decided(pairs.select("dataset_id", "request_id", F.transform("__own", lambda r: rule(r["rule"], F.element_at(r["levels"], F.col("__at")))).alias("rules")))
    own = F.array(rule(first, _permission_level()))
    rest = F.transform("modifiers", lambda m: rule(F.trim(m["id"]), _modifier_level(m, as_of)))
    return decided(profiles.crossJoin(few(requests)).select("dataset_id", "request_id", F.concat(own, F.coalesce(rest, F.slice(own, 1, 0))).alias("rules")))


def blocking(decisions: DataFrame, site: str = "dataset_id", study: str = "request_id") -> DataFrame:
    """K2: one row for each site that blocks a study, with n_blocking, the study's number of such sites."""
    rows = decisions.filter("decision <> 'permitted'").select(study, site)
    return rows.join(rows.groupBy(study).agg(F.count("*").alias("n_blocking")), study)


def fingerprint(df: DataFrame, key: list[str], order: str, line: Column, fan: int = FAN, parted_by: str = "\n") -> DataFrame:
    """G5 (action): SHA-256 of a group's lines in order, parted by line feeds or another string.

    A group of more than `fan` lines is a tree: each `fan` lines in order are hashed, and the digests take the lines' place
    until one is left; a digest alone in its block is passed on. So no task holds more than `fan` lines of a group.
    """
    x = rank_within(df.select(*key, F.col(order).alias("__o"), line.alias("__l")), key, ["__o", "__l"], "__r").select(*key, "__r", "__l")
    leaf = True
    while True:
        x = x.groupBy(*key, F.floor(F.col("__r") / fan).alias("__b")).agg(F.array_sort(F.collect_list(F.struct("__r", "__l"))).alias("__a"))
        digest = F.sha2(F.array_join(F.col("__a")["__l"], parted_by).cast("binary"), 256)
        if not leaf:
            digest = F.when(F.size("__a") == 1, F.col("__a")[0]["__l"]).otherwise(digest)
        x = cut(x.select(*key, F.col("__b").alias("__r"), digest.alias("__l")))
        if x.filter("__r > 0").isEmpty():
            return x.select(*key, F.col("__l").alias("fingerprint"))
        leaf = False


def whole_digest(df: DataFrame, key: str, order: str, line: Column, fan: int = FAN) -> DataFrame:
    """(key, digest): SHA-256 of all of a group's lines in order, end to end, however many there are.

    Lines are ranked by ranges. A group of up to `fan` lines is hashed as one string. A longer one is cut into blocks by many
    tasks, and one task lets the blocks flow through the hash, one at a time; SHA-256 can't be taken in parts.
    """
    x = rank_within(df.select(key, F.col(order).alias("__o"), line.alias("__l")), [key], ["__o", "__l"], "__r").select(key, "__r", "__r_n", "__l")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("__r", "__l")))["__l"], "").alias("__text")
    few = x.filter(F.col("__r_n") <= fan).groupBy(key).agg(text).select(key, F.sha2(F.encode("__text", "UTF-8"), 256).alias("digest"))
    blocks = x.filter(F.col("__r_n") > fan).groupBy(key, F.floor(F.col("__r") / FLOW).alias("__b")).agg(text)
    schema = T.StructType([df.schema[key], T.StructField("digest", T.StringType())])

    def run(batches):
        at, h = None, None  # a group's first block is block 0
        for batch in batches:
            rows = []
            for k, b, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b == 0:
                    if h:
                        rows.append((at, h.hexdigest()))
                    at, h = k, hashlib.sha256()
                h.update(part.encode())
            if rows:
                yield made(batch, rows)
        if h:
            yield made(batch, [(at, h.hexdigest())])

    def made(batch, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows])], names=[key, "digest"])

    many = blocks.repartition(key).sortWithinPartitions(key, "__b").mapInArrow(run, schema)
    return few.unionByName(many)


def diff_manifest(a: DataFrame, b: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Paths missing from b, extra in b, or with another digest."""
    x = a.select(key, F.col(digest).alias("__a")).join(b.select(key, F.col(digest).alias("__b")), key, "full")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") != F.col("__b"), "differs")
    return x.withColumn("state", state).filter(F.col("state").isNotNull()).select(key, "state")


def content_manifest(files: DataFrame, key: str, content: Column, parent: Column) -> DataFrame:
    """Path, parent, size and SHA-256 of contents."""
    return files.select(F.col(key).cast("string").alias("path"), parent.cast("string").alias("parent"), F.octet_length(content).cast("long").alias("size"), F.sha2(content.cast("binary"), 256).alias("sha256"))


def bundle_ids(manifest: DataFrame) -> DataFrame:
    """G6 (action): one level of the Merkle tree: each parent's fingerprint of its children's names and digests in name order,
    with size."""
    ids = fingerprint(manifest, ["parent"], "path", F.concat_ws(" ", "path", "sha256"))
    size = manifest.groupBy(F.col("parent").alias("__parent")).agg(F.sum("size").alias("size"))
    x = ids.join(size, F.col("parent").eqNullSafe(F.col("__parent")))
    return x.select(F.col("parent").alias("path"), "size", F.col("fingerprint").alias("sha256"))


def _parent(path: Column) -> Column:
    """The directory a path is in: "" is the root, which is in none."""
    return F.when(path != "", F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))


TREE = "path string, parent string, name string, depth int, is_bundle boolean, size long, id string, checksum string"


def content_tree(files: DataFrame, excluded: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """G6 (action): TREE, every file and directory of (path, size, sha256), from the leaves to the root, whose path is "".

    A file's id and checksum are its SHA-256. A directory's id is the SHA-256 of its children's names and ids in name order
    (name, NUL, id, line feed), and its checksum that of their sorted checksums, each as whole_digest() takes it. Names in `excluded` are no objects. Directories are made depth by depth, all of a depth at once. A
    path that is given twice is an error, and so is one that is both a file and a directory.
    """
    path = F.col("path")
    leaves = files.select("path", _parent(path).alias("parent"), F.element_at(F.split(path, "/"), -1).alias("name"), F.size(F.split(path, "/")).alias("depth"), F.lit(False).alias("is_bundle"), F.col("size").cast("long").alias("size"), F.col("sha256").alias("id"), F.col("sha256").alias("checksum"))
    if excluded:
        leaves = leaves.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    leaves = cut(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    level, out = leaves.filter(F.col("depth") == deepest), leaves
    for depth in range(deepest, 0, -1):
        level = cut(level)
        ids = whole_digest(level, "parent", "name", F.concat("name", F.lit("\0"), "id", F.lit("\n")), fan).withColumnRenamed("digest", "id")
        sums = whole_digest(level, "parent", "checksum", F.col("checksum"), fan).withColumnRenamed("digest", "checksum")
        made = level.groupBy("parent").agg(F.sum("size").alias("size")).join(ids, "parent").join(sums, "parent")
        made = made.select(F.col("parent").alias("path"), _parent(F.col("parent")).alias("parent"), F.element_at(F.split("parent", "/"), -1).alias("name"), F.lit(depth - 1).alias("depth"), F.lit(True).alias("is_bundle"), "size", "id", "checksum")
        out = out.unionByName(made)
        level = made.unionByName(leaves.filter(F.col("depth") == depth - 1))
    out = cut(out)
    if not out.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("some paths occur twice, or are both a file and a directory")
    return out


def verify_tree(recorded: DataFrame, files: DataFrame, excluded: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """G6 (action): (path, state) of all problems of a recorded TREE against the files that are there, both ways and all the way
    down: missing, extra, changed (a file's bytes, or a file for a directory or the other way round), and record, a directory
    whose recorded children do not hash to its id. Of what is missing or extra only the topmost object is named.
    """
    there = content_tree(files, excluded, fan).select("path", F.col("is_bundle").alias("__bundle"), F.col("id").alias("__id"))
    both = cut(recorded.select("path", "is_bundle", "id").join(there, "path", "full"))
    kind = F.when(F.col("__id").isNull(), "missing").when(F.col("id").isNull(), "extra").when((F.col("is_bundle") != F.col("__bundle")) | (~F.col("is_bundle") & (F.col("id") != F.col("__id"))), "changed")
    problem = both.select("path", _parent(F.col("path")).alias("parent"), kind.alias("state")).filter(F.col("state").isNotNull())
    covered = problem.filter("state IN ('missing', 'extra', 'changed')").select(F.col("path").alias("parent"))
    problem = problem.join(covered, "parent", "left_anti").select("path", "state")
    children = recorded.filter("parent IS NOT NULL")
    made = whole_digest(children, "parent", "name", F.concat("name", F.lit("\0"), "id", F.lit("\n")), fan)
    bundles = recorded.filter("is_bundle").select(F.col("path").alias("parent"), "id").join(made, "parent", "left")
    wrong = bundles.filter(~F.col("id").eqNullSafe(F.col("digest"))).select(F.col("parent").alias("path"), F.lit("record").alias("state"))
    return problem.unionByName(wrong)


def scan_files(spark, path: str) -> DataFrame:
    """(path, length, content) of a directory's files, for content_manifest() and content_tree().

    Spark's scan passes over files without a byte; these are taken from the list of files that it makes at the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(x)),) for x in found.inputFiles()], "path string")
    found = found.select("path", "length", "content")
    empty = listed.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return found.unionByName(empty)
