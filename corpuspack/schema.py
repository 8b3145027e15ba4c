"""Fixed schemas of the tables this package reads and writes."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: Input: one row per text file.
SOURCE_FILES = _struct(
    repo=T.StringType(), path=T.StringType(), content=T.StringType(), size_bytes=T.LongType()
)

#: Input: one row per file not yet known to be text.
RAW_FILES = _struct(repo=T.StringType(), path=T.StringType(), raw=T.BinaryType(), size_bytes=T.LongType())

#: Input: remote blobs, looked up by content hash.
BLOBS = _struct(repo=T.StringType(), sha=T.StringType(), content=T.StringType())

#: Where a listing that is not JSON is kept.
BAD_LISTING = "_bad"

#: JSON body of a remote tree listing; fields outside it are ignored. Values are taken as text, since hosts write
#: numbers and flags in more than one way.
TREE_LISTING = T.StructType(
    [
        T.StructField("truncated", T.StringType()),
        T.StructField(
            "tree",
            T.ArrayType(_struct(path=T.StringType(), type=T.StringType(), size=T.StringType(), sha=T.StringType())),
        ),
        T.StructField(BAD_LISTING, T.StringType()),
    ]
)

#: Output: ordered pieces of the documents. Sorting by the first five columns and
#: concatenating ``fragment`` gives each document.
FRAGMENTS = _struct(
    repo=T.StringType(),
    output=T.StringType(),
    section=T.IntegerType(),
    part=T.IntegerType(),
    sort_key=T.StringType(),
    fragment=T.StringType(),
)
FRAGMENT_ORDER = ["repo", "output", "section", "part", "sort_key"]
