"""Rule classifiers, as Column expressions. Values under `Fixed values` are given by the data contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import suffix

# Duration buckets in seconds, each with its upper end.
DURATION_BUCKETS = ((4.0, "00_to_04"), (8.0, "04_to_08"), (15.0, "08_to_15"), (30.0, "15_to_30"))
LONGEST_BUCKET = "30_plus"
# Licence categories by URL part, in the order in which they are tried; a title with cc0 comes first.
LICENSE_URLS = (
    (r"/publicdomain/zero/", "ALLOW_CC0"),
    (r"/licenses/by-nc-sa/", "ALLOW_BY_NC_SA"),
    (r"/licenses/by-nc-nd/|/licenses/by-nd/", "EXCLUDE_ND"),
    (r"/licenses/by-nc/", "ALLOW_BY_NC"),
    (r"/licenses/by-sa/", "ALLOW_BY_SA"),
    (r"/licenses/by/([0-9]|$)", "ALLOW_BY"),
    (r"^$", "EXCLUDE_UNKNOWN"),
    (r"fma_license|music-sharing|sound_recording_common_law|orphan_work", "EXCLUDE_RESTRICTED"),
)
LICENSE_OTHER = "EXCLUDE_CUSTOM"
# Signatures that an extension may have.
EXTENSION_SIGNATURES = {
    ".zip": ("ZIP",),
    ".wav": ("WAV",),
    ".flac": ("FLAC",),
    ".mp3": ("MP3_ID3", "MP3_FRAME"),
    ".csv": ("UTF8_TEXT", "UTF8_TEXT_OR_EMPTY"),
    ".py": ("EMPTY", "UTF8_TEXT", "UTF8_TEXT_OR_EMPTY"),
    ".txt": ("EMPTY", "UTF8_TEXT", "UTF8_TEXT_OR_EMPTY"),
    ".json": ("JSON_TEXT", "UTF8_TEXT", "UTF8_TEXT_OR_EMPTY"),
    ".md": ("UTF8_TEXT", "UTF8_TEXT_OR_EMPTY"),
    ".pth": ("ZIP", "PYTHON_PICKLE_OR_TORCH", "BINARY_UNKNOWN"),
    ".pt": ("ZIP", "PYTHON_PICKLE_OR_TORCH", "BINARY_UNKNOWN"),
    ".bin": ("ZIP", "BINARY_UNKNOWN", "PYTHON_PICKLE_OR_TORCH"),
}
# ZIP compression methods.
COMPRESSIONS = {0: "STORED", 8: "DEFLATED", 12: "BZIP2", 14: "LZMA"}
# What the first 16 bytes of a file, in hex, look like; no two fit one file but RIFF and its WAVE.
MAGIC = {
    "WAV": "^52494646.{8}57415645",
    "FLAC": "^664C6143",
    "MP3_ID3": "^494433",
    "MP3_FRAME": "^FF[EF]",
    "ZIP": "^504B(0304|0506)",
    "PYTHON_PICKLE_OR_TORCH": "^80",
    "JSON_TEXT": "^7B",
}
AUDIO = ("WAV", "FLAC", "MP3_ID3", "MP3_FRAME")
#: Bytes that a file is judged by; the least share of printable characters of text; how listings and sources start.
HEAD_BYTES, PRINTABLE, SOURCE = 64, 0.85, r"^\s*(import |from |#|-)"


def ordered(rules: tuple[tuple[Column, str], ...], other: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(other)


def license_category(title: Column, url: Column) -> Column:
    t, u = (F.lower(F.coalesce(F.trim(x), F.lit(""))) for x in (title, url))
    rules = [(u.rlike(p), n) for p, n in LICENSE_URLS]
    rules[0] = (rules[0][0] | t.contains("cc0"), rules[0][1])
    return ordered(tuple(rules), LICENSE_OTHER)


def duration_bucket(seconds: Column) -> Column:
    return ordered(tuple((seconds <= end, name) for end, name in DURATION_BUCKETS), LONGEST_BUCKET)


def in_scope(subset: Column, scopes: dict[str, tuple[str, ...]], scope: str) -> Column:
    return F.coalesce(subset.isin(*scopes[scope]), F.lit(False))


def rights(provider: Column, tiers: tuple[tuple[tuple[str, ...], dict], ...], other: dict) -> Column:
    """A struct of constants by the set that the provider is in."""
    struct = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    out = F.when(provider.isin(*tiers[0][0]), struct(tiers[0][1]))
    for names, values in tiers[1:]:
        out = out.when(provider.isin(*names), struct(values))
    return out.otherwise(struct(other))


def by_prefix(x: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    return ordered(tuple((x.startswith(p), n) for p, n in rules), other)


def stratum(dataset: Column, family: Column, strata: dict[str, str], held_out: tuple[str, ...] = ()) -> Column:
    """A training stratum by dataset; null for held-out families; an unknown dataset fails."""
    out = F.when(family.isin(*held_out), F.lit(None).cast("string")) if held_out else F.when(F.lit(False), F.lit(""))
    for name, value in strata.items():
        out = out.when(dataset == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no stratum for dataset "), F.coalesce(dataset, F.lit("null")))))


def safe_member(path: Column) -> Column:
    """Whether an archive member stays below where it is extracted: not absolute, no .. part, no drive in the first part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return ~p.startswith("/") & ~F.array_contains(parts, "..") & ~F.coalesce(F.get(parts, F.lit(0)).contains(":"), F.lit(False))


def is_symlink(external_attributes: Column) -> Column:
    return F.shiftright(external_attributes, 16).bitwiseAND(0o170000) == 0o120000


def compression_name(code: Column) -> Column:
    """The method's name; UNKNOWN_n for one without."""
    return F.coalesce(ordered(tuple((code == k, v) for k, v in COMPRESSIONS.items())), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def _magic(content: Column, names: tuple[str, ...]) -> Column:
    return ordered(tuple((F.hex(F.substring(content, 1, 16)).rlike(MAGIC[n]), n) for n in names))


def audio_signature(content: Column) -> Column:
    """WAV, FLAC, MP3_ID3, MP3_FRAME or UNKNOWN by the first bytes."""
    return F.coalesce(_magic(content, AUDIO), F.lit("UNKNOWN"))


def _text_kind(content: Column) -> Column:
    """The kind of a text by its head as UTF-8, in any script; broken characters, as at its end, are left out."""
    text = F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, HEAD_BYTES).cast("string")), "^\ufeff|\ufffd", "")
    shown = F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \r\n\t]]", "")) / F.nullif(F.length(text), F.lit(0))
    kind = F.when(text.contains(",") | text.rlike(SOURCE), "UTF8_TEXT").otherwise("UTF8_TEXT_OR_EMPTY")
    return F.when(F.coalesce(shown, F.lit(0.0)) < PRINTABLE, "BINARY_UNKNOWN").otherwise(kind)


def file_signature(content: Column) -> Column:
    """EMPTY, a name of MAGIC, or the kind of text that it is, if it is any."""
    return F.when(F.length(content) == 0, "EMPTY").otherwise(F.coalesce(_magic(content, tuple(MAGIC)), _text_kind(content)))


def extension_matches(name: Column, signature: Column) -> Column:
    """MATCH, MISMATCH, or NO_SIGNATURE_RULE for an extension without a rule."""
    own = suffix(name)
    allowed = F.create_map(*[x for k, v in EXTENSION_SIGNATURES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(F.try_element_at(allowed, own).isNull(), "NO_SIGNATURE_RULE").when(F.array_contains(F.try_element_at(allowed, own), signature), "MATCH").otherwise("MISMATCH")


def locator(x: Column) -> Column:
    """struct(kind, container, member, row) of a path, 'zip://container!/member' or 'parquet://path#row=n'; a broken one fails."""
    archive = F.regexp_extract(x, r"(?s)^zip://(.+?)!/(.+)$", 1)
    member = F.regexp_extract(x, r"(?s)^zip://(.+?)!/(.+)$", 2)
    table, row = (F.regexp_extract(x, r"(?s)^parquet://(.+)#row=(\d+)$", k) for k in (1, 2))
    null = lambda kind: F.lit(None).cast(kind)
    make = lambda kind, container, m, r: F.struct(F.lit(kind).alias("kind"), container.alias("container"), m.alias("member"), r.alias("row"))
    broken = F.raise_error(F.concat(F.lit("broken locator "), x)).cast("string")
    return (
        F.when(x.startswith("zip://"), make("zip", F.when(archive != "", archive).otherwise(broken), member, null("long")))
        .when(x.startswith("parquet://"), make("parquet", F.when(table != "", table).otherwise(broken), null("string"), F.nullif(row, F.lit("")).cast("long")))
        .otherwise(make("file", x, null("string"), null("long")))
    )


def archive_member(path: Column, families: tuple[tuple[tuple[str, ...], str, str, str], ...], generators: dict[str, str], nested_copy: str = "generated") -> Column:
    """struct(directory, role, source_family, source_id, generator, content_group_key) of a member's path, by its second part.

    families: (directories, family, pattern of the id with one group, printf format of the id; '' keeps the text in upper case). Below a nested
    folder of the given name, members of families with a format are redundant copies.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = F.size(parts)
    directory = F.when(n > 2, parts[1]).otherwise("")
    name = F.element_at(parts, -1)
    family, source_id, role = F.lit("unknown"), F.lit(""), F.lit("generated")
    for directories, own, pattern, form in families:
        here = directory.isin(*directories)
        found = F.regexp_extract(name, f"(?i){pattern}", 1)
        made = F.format_string(form, F.nullif(found, F.lit("")).cast("long")) if form else F.upper(found)
        family = F.when(here, own).otherwise(family)
        source_id = F.when(here, F.when(found != "", made).otherwise("")).otherwise(source_id)
        if form:
            role = F.when(here & (n >= 4) & (F.get(parts, F.lit(2)) == nested_copy), "redundant_duplicate_copy").otherwise(role)
    known = F.create_map(*[F.lit(x) for kv in generators.items() for x in kv])
    group = F.when(source_id != "", F.concat(family, F.lit(":"), source_id)).otherwise(F.concat(F.lit("unparsed:"), path))
    return F.struct(directory.alias("directory"), role.alias("role"), family.alias("source_family"), source_id.alias("source_id"), F.coalesce(F.try_element_at(known, directory), F.lit("unknown")).alias("generator"), group.alias("content_group_key"))
