"""Merkle fixity audit of WARC records: hash trees over ordered offset ranges of replicas.

Method. Records have an address: the number of their file and the offset in it. Records are hashed;
hashes of a range of 64 KB of offsets make a leaf, 64 neighbouring nodes make a node of the next level, up to one root.
Two replicas are compared from the root; only the branches that differ are followed to
the next level, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.session import materialize

#: Pages per WARC file (by page_id), and the bits of an offset inside it.
FILE_PAGES = 512
_FILE_BITS = 40
#: Bits of a leaf's offset range, and of the fan-out.
_LEAF, _FAN = 16, 6
_LEVELS = range(_LEAF, 63, _FAN)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def archive(pages: DataFrame) -> DataFrame:
    """WARC records of pages: ``page_id, file, offset, length, record``.

    A file holds the pages of a range of ids in order (null ids: file -1), so a file is bounded
    unless ids repeat. The records are dealt out once, by file.
    """
    made = pages.select(
        "page_id",
        F.floor(F.coalesce(F.col("page_id"), F.lit(-1)) / FILE_PAGES).cast("long").alias("file"),
        record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    ).withColumns({"length": F.octet_length("record").cast("long"), "sha256": F.sha2("record", 256)})
    # Rows of a page with the same hash are equal records, so their order does not matter.
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha256").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "page_id", "file", "offset", "length", "record"
    )


def hashes(replica: DataFrame) -> DataFrame:
    """Address and hash of every stored record: ``address, sha256``; a lost record (null) has no row."""
    address = F.shiftleft(F.col("file") + 1, _FILE_BITS) + F.col("offset")
    return replica.where("record is not null").select(address.alias("address"), F.sha2("record", 256).alias("sha256"))


def _level(nodes: DataFrame, bits: int) -> DataFrame:
    """One hash per range, over the ordered children and their places."""
    return nodes.groupBy(F.shiftright("address", bits).alias("node")).agg(
        F.sha2(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("address", "sha256"))),
                    lambda x: F.concat_ws(":", x["address"].cast("string"), x["sha256"]),
                ),
                ",",
            ),
            256,
        ).alias("sha256")
    )


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of a replica's tree, from the ranges of records up to the root: ``node, sha256`` each.

    A node hashes at most one leaf range or 64 children.
    """
    levels = [materialize(_level(leaves, _LEAF), "merkle-leaves")]
    for _ in list(_LEVELS)[1:]:
        levels.append(_level(levels[-1].select(F.col("node").alias("address"), "sha256"), _FAN))
    return levels


def _differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    other = b.select(key, F.col("sha256").alias("other"))
    return a.join(other, key, "full_outer").where(~F.col("sha256").eqNullSafe(F.col("other")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``address, status`` (altered, missing in b, extra in b).

    ``a`` and ``b`` come from :func:`hashes`. Equal roots end the descent at once. Empty
    replicas are equal to each other.
    """
    trees = tree(a), tree(b)
    suspects = materialize(_differ(trees[0][-1], trees[1][-1], "node").select("node"), "merkle-suspects")
    for level in range(len(trees[0]) - 2, -1, -1):
        if suspects.isEmpty():
            break
        below = [
            t[level].withColumn("parent", F.shiftright("node", _FAN)).join(
                suspects.select(F.col("node").alias("parent")), "parent", "left_semi"
            )
            for t in trees
        ]
        suspects = materialize(_differ(*below, "node").select("node"), "merkle-suspects")
    below = [
        r.withColumn("node", F.shiftright("address", _LEAF)).join(suspects, "node", "left_semi").select("address", "sha256")
        for r in (a, b)
    ]
    status = F.when(F.col("other").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("altered")
    return _differ(*below, "address").select("address", status.alias("status"))


def audited(replica: DataFrame, other: DataFrame) -> DataFrame:
    """Every record of ``replica`` with its hash and what the audit of ``other`` found: ok, altered or missing."""
    own, theirs = materialize(hashes(replica), "merkle-hashes"), materialize(hashes(other), "merkle-hashes")
    found = audit(own, theirs)
    address = F.shiftleft(F.col("file") + 1, _FILE_BITS) + F.col("offset")
    return (
        replica.select("page_id", "file", "offset", "length", address.alias("address"))
        .join(own, "address")
        .join(found, "address", "left")
        .select("page_id", "file", "offset", "length", F.col("sha256").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))
    )
