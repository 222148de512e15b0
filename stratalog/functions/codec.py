"""Identities, digests and names as column expressions.

A digest is SHA-256 over a frame: an ASCII prefix ending in a zero byte, a 4-byte version, then fixed-width
big-endian integers and bytes.  Prefixes start with a namespace that is a parameter, so an existing store's
identities can be kept by passing its namespace.
"""

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "stratalog"
INT63_MAX = (1 << 63) - 1


def u32be(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))


def u64be(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def text_bytes(value: str) -> Column:
    return F.lit(value.encode()) if value else F.lit(b"")


def frame(kind: str, *parts: Column, version: int = 1, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"{namespace}-{kind}".encode() + b"\0"), u32be(F.lit(version)), *parts)


def digest(preimage: Column) -> Column:
    return F.unhex(F.sha2(preimage, 256))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def canonical_value_digest(domain: str, payload: Column, **options) -> Column:
    return digest(frame("canonical-value", u32be(F.lit(len(domain))), text_bytes(domain), u64be(F.octet_length(payload)), payload, **options))


def publication_key(gid: Column, **options) -> Column:
    return digest(frame("publication-key", u64be(gid), **options))


def gallery_key(scope_key: Column, locator_sha256: Column, **options) -> Column:
    return digest(frame("gallery-key", scope_key, locator_sha256, **options))


def file_key(name: Column, **options) -> Column:
    return digest(frame("file-key", u32be(F.octet_length(name)), name, **options))


def source_scope_key(provider: str, root_sha256: Column, policy_version: int, **options) -> Column:
    return digest(frame("source-scope-key", u32be(F.lit(len(provider))), text_bytes(provider), root_sha256, u32be(F.lit(policy_version)), **options))


def segment_frame(kind: str, segments: Column, **options) -> Column:
    """A path as its number of segments and each segment's length and bytes (array of binary)."""
    body = F.aggregate(segments, F.lit(b""), lambda acc, s: F.concat(acc, u32be(F.octet_length(s)), s))
    return frame(kind, u32be(F.size(segments)), body, **options)


def source_relative_locator_digest(segments: Column, **options) -> Column:
    return canonical_value_digest("source_relative_locator_v1", segment_frame("source-relative-locator", segments, **options), **options)


def source_root_digest(segments: Column, **options) -> Column:
    return canonical_value_digest("source_root_v1", segment_frame("source-root", segments, **options), **options)


def effective_content_payload(digests: Column, **options) -> Column:
    """Sorted digests (repeats stay) after their count."""
    ordered = F.array_sort(digests)
    return F.unhex(F.concat(F.hex(frame("effective-content", u64be(F.size(digests)), **options)), F.array_join(F.transform(ordered, F.hex), "")))


def effective_content_digest(digests: Column, **options) -> Column:
    return canonical_value_digest("effective_content_v1", effective_content_payload(digests, **options), **options)


def artifact_semantics_digest(*components: Column, **options) -> Column:
    """Six component digests (source manifest, member plan, effective content, selected, owner, policy)."""
    return canonical_value_digest("artifact_semantics_v1", frame("artifact-semantics", *components, **options), **options)


def decimal_positive(c: Column) -> Column:
    """The positive 63-bit integer that the text spells canonically, else null."""
    return F.when(c.rlike("^[1-9][0-9]{0,18}$"), c.try_cast("long"))


def publication_id(gid: Column, prefix: str = "urn:stratalog:gallery:") -> Column:
    return F.concat(F.lit(prefix), gid.cast("string"))


def decode_publication_id(c: Column, prefix: str = "urn:stratalog:gallery:") -> Column:
    return F.when(c.startswith(prefix), decimal_positive(F.substr(c, F.lit(len(prefix) + 1))))


def artifact_id(gid: Column, sha256: Column, prefix: str = "urn:stratalog:artifact:cbz:") -> Column:
    return F.concat(F.lit(prefix), gid.cast("string"), F.lit(":sha256:"), hex_lower(sha256))


def decode_artifact_id(c: Column, prefix: str = "urn:stratalog:artifact:cbz:") -> Column:
    """struct(gid, sha256), or null for any other spelling."""
    rest = F.substr(c, F.lit(len(prefix) + 1))
    gid = decimal_positive(F.regexp_extract(rest, "^([0-9]+):sha256:", 1))
    sha = F.regexp_extract(rest, "^[0-9]+:sha256:([0-9a-f]{64})$", 1)
    return F.when(c.startswith(prefix) & gid.isNotNull() & (sha != ""), F.struct(gid.alias("gid"), F.unhex(sha).alias("sha256")))


def artifact_name(gid: Column, prefix: str = "item-", suffix: str = ".cbz") -> Column:
    return F.concat(F.lit(prefix), gid.cast("string"), F.lit(suffix))


def decode_artifact_name(c: Column, prefix: str = "item-", suffix: str = ".cbz") -> Column:
    inner = F.substr(c, F.lit(len(prefix) + 1), F.length(c) - len(prefix) - len(suffix))
    return F.when(c.startswith(prefix) & c.endswith(suffix) & (F.length(c) > len(prefix) + len(suffix)), decimal_positive(inner))


def artifact_locator(sha256: Column) -> Column:
    h = hex_lower(sha256)
    return F.array(F.lit("sha256"), F.substr(h, F.lit(1), F.lit(2)), F.concat(h, F.lit(".cbz")))


def archive_member_name(position: Column, role: Column, kind: Column, excluded: Column) -> Column:
    leaf = F.when(role == "METADATA", "metadata.txt").when(kind == "GIF_NORMALIZE", "content.gif").when(kind == "JPEG_NORMALIZE", "content.jpg").otherwise("content.bin")
    return F.when(~excluded, F.concat(F.lower(F.lpad(F.hex(position), 16, "0")), F.lit("__"), leaf))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@cache
def _lower_pairs() -> tuple[str, str]:
    """Letters and their lower forms, one code point to one."""
    pairs = [(c, c.lower()[0]) for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.lower() != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simple_lower(c: Column) -> Column:
    """Lower case code point by code point, as DuckDB's lower(): no final sigma, and a dotted capital I is i."""
    return F.translate(c, *_lower_pairs())


#: The upload marker, the metadata file, suffixes that get a transform.
MARKER = "already uploaded"
METADATA_NAME = "galleryinfo.txt"
GIF_SUFFIX = ".gif"
JPEG_SUFFIXES = (".avif", ".bmp", ".jpeg", ".jpg", ".png", ".webp")


def already_uploaded(tag_values: Column) -> Column:
    return F.exists(tag_values, lambda t: ascii_fold(t) == MARKER)


def file_role(name: Column) -> Column:
    return F.when(name == METADATA_NAME, "METADATA").otherwise("CONTENT")


def transform_kind(name: Column) -> Column:
    suffix = ascii_fold(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(suffix == GIF_SUFFIX, "GIF_NORMALIZE").when(suffix.isin(*JPEG_SUFFIXES), "JPEG_NORMALIZE").otherwise("RAW_COPY")


def casefold(c: Column) -> Column:
    """Full Unicode case folding as UTF-8 bytes. ASCII texts stay in the JVM; only others pass through Arrow."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.casefold())

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(fold(c)).cast("binary")


def ascii_casefold(c: Column) -> Column:
    """Case folding where all texts are known to be ASCII."""
    return F.lower(c).cast("binary")


# Domain checks: true for a valid value, never null.
def valid_int63(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def valid_positive_int63(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def valid_uint32(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 0xFFFFFFFF), F.lit(False))


def valid_bytes(c: Column, length: int) -> Column:
    return F.coalesce(F.octet_length(c) == length, F.lit(False))


def valid_name(c: Column, most: int = 255) -> Column:
    """A direct child's name: 1 to ``most`` bytes, no slash or zero byte, not a dot entry."""
    h = F.hex(c)
    ok = F.octet_length(c).between(1, most) & ~h.rlike("^(..)*(2F|00)(..)*$") & ~h.isin("2E", "2E2E")
    return F.coalesce(ok, F.lit(False))


def valid_ascii_identifier(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(c.isin(*allowed), F.lit(False))


def scalar_count(title: Column) -> Column:
    return F.char_length(title)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))
