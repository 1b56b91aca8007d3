"""Column expressions for money amounts, links and row rendering.

Native Spark expressions only. Java regex differs from Python's in two places that
matter here: ``\\s``/``\\d`` are ASCII, and case-insensitive matching of accented letters
needs Unicode case folding. The patterns below spell Python's whitespace set out as a
character class (cheaper than the ``(?U)`` flag) and use ``(?iu)`` for case folding.
Digits are matched as ASCII ``[0-9]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from plantwise.functions.cleaning import PY_WHITESPACE, strip_ws

# Fixed values that must match the source behaviour.
# Regex patterns exactly as the source states them (Python syntax); `java_regex` below
# turns each into the equivalent Java pattern.
MONEY_PATTERN_SOURCE = r"(?<!R)\$\s?([\d.,]+)"
LINK_PATTERN_SOURCE = r"((?:Link de [A-Za-zãõí\s]+:?\s*)?https?://[^\s\)\n]+)"
LINK_PARTS_PATTERN_SOURCE = r"(?:Link de ([A-Za-zãõí\s]+):?\s*)?(https?://[^\s\)\n]+)"
URL_TAIL_PATTERN_SOURCE = r"[.\)\]\s]+$"
DRIVE_LINK_PATTERN = r"https?://drive\.google\.com/file/d/[a-zA-Z0-9_-]+/view\?usp=drive_link"
IMAGE_LINKS_HEADER_SOURCE = r"Links de imagens:?"
LEADING_BULLET_SOURCE = r"^[\s\n]*[\*\-]\s*"
NO_TAX_NOTE = "(valores sem impostos)"
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".m4v", ".webm", ".mkv")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
DRIVE_HOST = "drive.google.com"
DRIVE_IMAGE_TAG_WORDS = ("máquina", "foto", "equipamento", "mídia", "apresentação")
DRIVE_DOWNLOAD_PREFIX = "https://drive.google.com/uc?export=download&id="
DRIVE_VIDEO_PREFIX = "https://drive.google.com/uc?id="
TRUNCATION_MARK = "\n...[CONTEXTO TRUNCADO]"


def java_regex(py_pattern: str, ignore_case: bool = False) -> str:
    """Translate a Python ``re`` pattern to the Java pattern with the same matches.

    Python's ``\\s`` is Unicode whitespace and Java's is ASCII: it becomes Python's
    whitespace set spelled out (cheaper than Java's ``(?U)`` flag). ``\\d`` becomes ASCII
    ``0-9`` (digits outside ASCII are not accepted; see README). A case-insensitive
    pattern gets ``(?iu)`` so accented letters fold like in Python.
    """
    out, in_class, i = [], False, 0
    while i < len(py_pattern):
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < len(py_pattern):
            nxt = py_pattern[i + 1]
            if nxt == "s":
                out.append(PY_WHITESPACE if in_class else f"[{PY_WHITESPACE}]")
            elif nxt == "d":
                out.append("0-9" if in_class else "[0-9]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


MONEY_PATTERN = java_regex(MONEY_PATTERN_SOURCE)
LINK_SEGMENT_PATTERN = java_regex(LINK_PATTERN_SOURCE, ignore_case=True)
LINK_PATTERN = java_regex(LINK_PARTS_PATTERN_SOURCE, ignore_case=True)
URL_TAIL_PATTERN = java_regex(URL_TAIL_PATTERN_SOURCE)
IMAGE_LINKS_HEADER_PATTERN = java_regex(IMAGE_LINKS_HEADER_SOURCE, ignore_case=True)
LEADING_BULLET_PATTERN = java_regex(LEADING_BULLET_SOURCE)

_PLAIN_NUMBER = r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def parse_money(mention: Column) -> Column:
    """Locale-free amount parse of a mention such as ``$1,234.56`` or ``$ 1.234,56``.

    Both separators: the last one is the decimal mark. Only commas: one comma with at
    most two digits after it is decimal, else thousands. One dot with exactly three
    characters after it is a thousands mark, else decimal. Several dots: thousands.
    Anything that is not then a plain number gives null.
    """
    return F.get(parse_money_array(F.array(mention)), 0)


def format_brl(n: Column) -> Column:
    """Two decimals, ``.`` thousands, ``,`` decimal; 0 < n < 0.01 shows as 0,01."""
    v = F.when((n > 0) & (n < 0.01), F.lit(0.01)).otherwise(n)
    return F.translate(F.format_number(v, 2), ",.", ".,")


def money_mentions(text: Column) -> Column:
    """Array of full mention strings, in text order."""
    return F.regexp_extract_all(text, F.lit(MONEY_PATTERN), 0)


def parse_money_array(mentions: Column) -> Column:
    """T2 over an array of mentions, as a chain of small ``transform`` steps.

    Lambdas of higher-order functions are evaluated without common-subexpression
    elimination, so the single-expression parse would recompute shared pieces many times
    per element; each step here references its input once or twice."""
    cleaned = F.transform(mentions, lambda m: F.replace(
        F.when(strip_ws(m).startswith("$"), strip_ws(m).substr(F.lit(2), F.length(m))).otherwise(strip_ws(m)),
        F.lit(" "), F.lit("")))
    shaped = F.transform(cleaned, lambda s: F.struct(
        s.alias("s"),
        (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))).alias("dots"),
        (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))).alias("commas"),
        (F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s))).alias("comma_last"),
        F.length(F.substring_index(s, ",", -1)).alias("after_comma"),
        F.length(F.substring_index(s, ".", -1)).alias("after_dot"),
    ))

    def normalise(x: Column) -> Column:
        s, dots, commas = x["s"], x["dots"], x["commas"]
        no_dots = F.replace(s, F.lit("."), F.lit(""))
        no_commas = F.replace(s, F.lit(","), F.lit(""))
        return strip_ws(
            F.when((commas > 0) & (dots > 0),
                   F.when(x["comma_last"], F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
            .when(commas > 0, F.when((commas == 1) & (x["after_comma"] <= 2), F.replace(s, F.lit(","), F.lit(".")))
                  .otherwise(no_commas))
            .when(dots == 1, F.when(x["after_dot"] == 3, no_dots).otherwise(s))
            .when(dots > 1, no_dots)
            .otherwise(s)
        )

    numbers = F.transform(shaped, normalise)
    return F.transform(numbers, lambda t: F.when(t.rlike(_PLAIN_NUMBER), t.try_cast("double")))


def _replacement(mention: Column, amount: Column, rate: Column) -> Column:
    converted = F.concat(
        F.replace(mention, F.lit("$"), F.lit("\\$")), F.lit(" (R\\$ "), format_brl(amount * rate), F.lit(")")
    )
    return F.when(amount.isNull() | rate.isNull(), mention).otherwise(converted)


def rewrite_money_frame(df, text_col: str, rate_col: str, out_col: str = "rewritten"):
    """T4: every mention gets its converted value appended; if there was a mention the
    text ends with a newline and the no-tax note. Text without a mention, or with no
    (or zero) rate, is returned unchanged.

    Built as successive projections (mentions and the text pieces between them; parsed
    amounts; replacements; assembly), so that each piece is computed once per row.
    """
    keep = [c for c in df.columns if c != out_col]
    text, rate = F.col(text_col), F.col(rate_col)
    step = df.select(*keep, money_mentions(text).alias("_m"), F.split(text, MONEY_PATTERN, -1).alias("_p"))
    step = step.select("*", parse_money_array(F.col("_m")).alias("_v"))
    step = step.select("*", F.zip_with("_m", "_v", lambda m, v: _replacement(m, v, rate)).alias("_r"))
    n = F.size("_m")
    step = step.select("*", F.concat(
        F.array_join(F.zip_with(F.slice("_p", 1, n), "_r", lambda a, b: F.concat(a, b)), ""),
        F.element_at("_p", -1)).alias("_body"))
    body = F.col("_body")
    noted = F.concat(body, F.when(body.endswith("\n"), F.lit("")).otherwise(F.lit("\n")), F.lit(NO_TAX_NOTE))
    out = F.when((n == 0) | rate.isNull() | (rate == 0), text).otherwise(noted)
    return step.select(*keep, out.alias(out_col))


def link_parts(text: Column) -> Column:
    """Array of link matches (optional tag + URL), in text order."""
    return F.regexp_extract_all(text, F.lit(LINK_SEGMENT_PATTERN), 1)


def link_tag(link: Column) -> Column:
    """Tag of a link match, lower-cased and trimmed ('' when absent)."""
    return strip_ws(F.lower(F.regexp_extract(link, LINK_PATTERN, 1)))


def link_url(link: Column) -> Column:
    """URL of a link match without back-ticks and trailing ``. ) ]`` / spaces."""
    url = F.replace(strip_ws(F.regexp_extract(link, LINK_PATTERN, 2)), F.lit("`"), F.lit(""))
    return F.regexp_replace(url, URL_TAIL_PATTERN, "")


def _contains_any(s: Column, needles: Sequence[str]) -> Column:
    cond = F.lit(False)
    for x in needles:
        cond = cond | s.contains(x)
    return cond


def media_type(url: Column) -> Column:
    """video/image when the lower-cased URL *contains* an extension, else drive for
    Drive URLs, else unknown."""
    low = F.lower(url)
    return (
        F.when(_contains_any(low, VIDEO_EXTENSIONS), F.lit("video"))
        .when(_contains_any(low, IMAGE_EXTENSIONS), F.lit("image"))
        .when(url.contains(DRIVE_HOST), F.lit("drive"))
        .otherwise(F.lit("unknown"))
    )


def render_kind(tag: Column, mtype: Column) -> Column:
    """Video > image > button, from the tag words and the media type."""
    is_video = tag.contains("vídeo") | tag.contains("video") | (mtype == "video")
    is_image = tag.contains("imagem") | tag.contains("foto") | (mtype == "image")
    drive_image = (mtype == "drive") & ~is_video & ~is_image & _contains_any(tag, DRIVE_IMAGE_TAG_WORDS)
    return (
        F.when(is_video, F.lit("video"))
        .when(is_image | drive_image, F.lit("image"))
        .otherwise(F.lit("button"))
    )


def drive_id(url: Column) -> Column:
    """File id after ``/file/d/`` (up to ``/``), else after ``id=`` (up to ``&``)."""
    by_path = F.substring_index(F.get(F.split(url, "/file/d/"), 1), "/", 1)
    by_query = F.substring_index(F.get(F.split(url, "id="), 1), "&", 1)
    out = F.when(url.contains("/file/d/"), by_path).when(url.contains("id="), by_query)
    return F.nullif(out, F.lit(""))


def drive_direct_url(url: Column, kind: Column) -> Column:
    """Direct form of a Drive URL by its render kind (videos are streamed, anything else
    is downloaded); null for other hosts and without an id."""
    prefix = F.when(kind == "video", F.lit(DRIVE_VIDEO_PREFIX)).otherwise(F.lit(DRIVE_DOWNLOAD_PREFIX))
    return F.when(url.contains(DRIVE_HOST), F.concat(prefix, drive_id(url)))


def strip_drive_links(text: Column) -> Column:
    """Remove shared-Drive view links."""
    return F.regexp_replace(text, DRIVE_LINK_PATTERN, "")


def answer_cleanup(text: Column) -> Column:
    """Drop the 'Links de imagens' header (any case), strip, drop one leading
    bullet; blank results become null (the caller drops them)."""
    t = strip_ws(F.regexp_replace(text, IMAGE_LINKS_HEADER_PATTERN, ""))
    t = F.regexp_replace(t, LEADING_BULLET_PATTERN, "")
    return F.nullif(t, F.lit(""))


def row_line(columns: Sequence[str], sep: str = " | ") -> Column:
    """``k: v`` for every non-null, non-blank value, joined by `` | ``."""
    items = []
    for c in columns:
        v = F.col(c).cast("string")
        items.append(F.when(v.isNotNull() & (strip_ws(v) != ""), F.concat(F.lit(f"{c}: "), v)))
    return F.concat_ws(sep, *items)
