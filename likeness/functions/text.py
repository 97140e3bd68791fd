"""Names, labels, checksums and request headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "pgm", "bmp", "gif")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$")


def image_format(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".jpg") | low.endswith(".jpeg"), "JPEG").when(low.endswith(".png"), "PNG").when(low.endswith(".bmp"), "BMP").otherwise("UNKNOWN")


def regex_label(name: Column, pattern: str = r"(.+?)(?:_\d+)?\.[^.]+$") -> Column:
    """Group 1 of the first hit, else null."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def flat_label(name: Column, separator: str = "_") -> Column:
    """The name without extension, up to its last separator if that does not come first."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    cut = F.length(stem) - F.length(F.substring_index(stem, separator, -1)) - len(separator)
    return F.when(stem.contains(separator) & (cut > 0), F.substring(stem, F.lit(1), cut.cast("int"))).otherwise(stem)


def yale_label(name: Column) -> Column:
    """The name, in lower case, up to its first dot, if it begins with "subject"."""
    name = F.lower(name)
    return F.when(name.startswith("subject"), F.substring_index(name, ".", 1))


def yale_condition(name: Column) -> Column:
    """Text between the first and the last dot, in lower case, else null."""
    return F.nullif(F.regexp_extract(F.lower(name), r"^[^.]*\.(.+)\.[^.]*$", 1), F.lit(""))


def words(s: Column) -> Column:
    return F.split(F.trim(s), r"\s+")


def csv_quoted(s: Column) -> Column:
    quote = s.contains(",") | s.contains('"') | s.contains("\n")
    return F.when(quote, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def model_base_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("")), F.lit("default"))


def truncated(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 2), F.lit(".."))).otherwise(s)


def file_size(n: Column) -> Column:
    """n B, or one decimal of KB, MB, GB in steps of 1024."""
    one = lambda by, unit: F.format_string("%.1f " + unit, n / F.lit(float(by)))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, one(1024, "KB")).when(n < 1024**3, one(1024**2, "MB")).otherwise(one(1024**3, "GB"))


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.when(original == 0, F.lit(1.0)).otherwise(compressed / F.when(original == 0, F.lit(1)).otherwise(original))


def trace_id(request: Column, correlation: Column) -> Column:
    """The first header that is not blank, else a random one."""
    return F.coalesce(F.nullif(F.trim(request), F.lit("")), F.nullif(F.trim(correlation), F.lit("")), F.uuid())


def client_key(forwarded: Column, remote: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), remote)


def error_code(message: Column) -> Column:
    """By the first phrase that the lower-cased message holds, in this order."""
    low = F.lower(message)
    rules = [(("no face", "face not"), "FACE_NOT_DETECTED"), (("multiple face",), "MULTIPLE_FACES"), (("quality",), "POOR_QUALITY"), (("too small", "dimension"), "IMAGE_TOO_SMALL"), (("too large",), "IMAGE_TOO_LARGE"), (("image", "format"), "INVALID_IMAGE_FORMAT")]
    out = F.lit("VALIDATION_ERROR")
    for phrases, code in reversed(rules):
        hit = low.contains(phrases[0])
        for p in phrases[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, code).otherwise(out)
    return out


def merged_map(base: Column, more: Column) -> Column:
    """Entries of both; of equal keys the later value."""
    keys = F.array_distinct(F.concat(F.map_keys(base), F.map_keys(more)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(more, k), F.element_at(base, k))))


def upload_error(content_type: Column, size: Column) -> Column:
    """Why an uploaded file is not taken, or null: it must be there, be an image, and have at most 10 MB."""
    return F.when(size.isNull() | (size == 0), "Image file is required").when(content_type.isNull() | ~content_type.startswith("image/"), "File must be an image").when(size > 10 * 1024 * 1024, "Image file is too large (max 10MB)")


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100.0)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)
