"""Text functions over Vietnamese legal prose. All are built-in expressions but Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Issuer keywords in the order in which they are tried.
ISSUERS = (
    ("văn phòng quốc hội", "Văn phòng Quốc hội"),
    ("ủy ban thường vụ quốc hội", "Ủy ban Thường vụ Quốc hội"),
    ("bộ nông nghiệp và phát triển nông thôn", "Bộ Nông nghiệp và Phát triển nông thôn"),
    ("bộ giao thông vận tải", "Bộ Giao thông vận tải"),
    ("bộ công an", "Bộ Công an"),
    ("bộ tư pháp", "Bộ Tư pháp"),
    ("bộ y tế", "Bộ Y tế"),
    ("bộ tài chính", "Bộ Tài chính"),
    ("bộ xây dựng", "Bộ Xây dựng"),
    ("bộ nông nghiệp", "Bộ Nông nghiệp và Phát triển nông thôn"),
    ("thủ tướng chính phủ", "Thủ tướng Chính phủ"),
    ("chính phủ", "Chính phủ"),
    ("quốc hội", "Quốc hội"),
    ("tòa án nhân dân tối cao", "Tòa án nhân dân tối cao"),
    ("viện kiểm sát nhân dân tối cao", "Viện kiểm sát nhân dân tối cao"),
)
# Letterhead that is no issuer.
HEADER = "cộng hòa xã hội chủ nghĩa việt nam"
MOTTOES = ("độc lập - tự do - hạnh phúc", "độc lập – tự do – hạnh phúc", "độc lập — tự do — hạnh phúc")
# Document type by the start of a line.
TYPE_PREFIXES = (
    ("VĂN BẢN HỢP NHẤT", "OTHER"), ("THÔNG TƯ LIÊN TỊCH", "CIRCULAR"), ("NGHỊ ĐỊNH", "DECREE"), ("THÔNG TƯ", "CIRCULAR"),
    ("QUYẾT ĐỊNH", "DECISION"), ("NGHỊ QUYẾT", "RESOLUTION"), ("LUẬT", "LAW"),
)
# Words that the tokeniser can drop.
STOPWORDS = ("và", "với", "để", "là", "các", "những", "một", "khi", "nếu", "thì", "cũng", "đều", "về", "từ", "ở", "bởi", "như", "hay")
# Fixed value: grammar of logical provision ids.
ID_GRAMMAR = (
    r"^[a-zđ]+-[0-9]+-[0-9]{4}"
    r"(?:__dieu-[0-9]+(?:__khoan-[0-9]+(?:__diem-[a-zđ])?)?"
    r"|__dieu-[0-9]+__bang-[0-9]+"
    r"|__dieu-[0-9]+__khoan-chuyen-tiep"
    r"|__phu-luc-[0-9]+(?:__bang-[0-9]+)?"
    r"|__chuyen-tiep-[0-9]+"
    r"|__tieu-de-[0-9]+)?$"
)
# Code points, as ranges, that no text of them alone makes NFC change: none decomposes for good or joins the one before it.
ASCII = r"\x{0}-\x{7F}"
LATIN = r"\x{0}-\x{2FF}"
SETTLED = LATIN + r"\x{400}-\x{482}\x{48A}-\x{52F}\x{1EA0}-\x{1EFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
TOKEN = rf"({LETTER}+)"


def _normal(form: str):
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal


def normalised(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Text that the form leaves as it is by its letters alone skips Python.

    A function in Python is evaluated for all rows, whatever condition stands around it, so such text is given to it as null.
    """
    # One range is tested far faster than many, and most texts need no more.
    same = text.rlike(rf"^[{LATIN if form == 'NFC' else ASCII}]*$")
    if form == "NFC":
        same = F.when(same, True).otherwise(text.rlike(rf"^[{SETTLED}]*$"))
    return F.coalesce(_normal(form)(F.when(~same, text)), text)


def collapsed(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column, unicode: bool = True) -> Column:
    return collapsed(normalised(text) if unicode else text)


def provision_text(text: Column) -> Column:
    """Compatibility normal form, collapsed, glued labels parted: ``a)Xe`` to ``a) Xe``."""
    return F.regexp_replace(collapsed(normalised(normalised(text, "NFKC"))), r"([a-zđ])\)(\S)", "$1) $2")


def folded(text: Column) -> Column:
    """Case folding for comparison: lower case with sharp s spelled out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, drop_stopwords: bool = False) -> Column:
    """Letter runs of the composed (NFC), lower-cased text, in order; digits part them."""
    found = F.regexp_extract_all(F.lower(normalised(text)), F.lit(TOKEN), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS)) if drop_stopwords else found


#: The Roman numerals that Unicode has as signs of their own, and what compatibility makes of them.
ROMAN_SIGNS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2170)}


def roman_letters(text: Column) -> Column:
    for sign, letters in ROMAN_SIGNS.items():
        text = F.replace(F.replace(text, F.lit(sign), F.lit(letters)), F.lit(chr(ord(sign) + 16)), F.lit(letters.lower()))
    return text


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral by a fold from the right; null for anything else."""
    letters = F.split(F.reverse(F.upper(text)), "")
    worth = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda a, c: F.struct((a["sum"] + F.when(worth(c) < a["last"], -worth(c)).otherwise(worth(c))).alias("sum"), worth(c).alias("last"))
    return F.when(text.rlike(r"(?i)^[IVXLCDM]+$"), F.aggregate(letters, start, step)["sum"])


def point_label(label: Column, ordinal: Column) -> Column:
    """Canonical point label: đ is always ``đ)``, a bare d needs its place in the run (4: ``d)``, 5: ``đ)``)."""
    letter = F.lower(F.regexp_extract(label, r"(?iu)^\s*(?:điểm\s+)?([a-zđ])[)）]", 1))
    return F.when(letter == "", None).when(letter == "d", F.when(ordinal == 4, "d)").when(ordinal == 5, "đ)")).otherwise(F.concat(letter, F.lit(")")))


def leaked_header(text: Column) -> Column:
    """The state header and the motto both stand in the text."""
    low, motto = F.lower(collapsed(text)), F.lit(False)
    for m in MOTTOES:
        motto = motto | F.lower(collapsed(text)).contains(m)
    return low.contains(HEADER) & motto


def issuer(text: Column) -> Column:
    """Canonical issuer by keyword after letterhead is removed; text without a keyword stays as it is, blank is null."""
    low = F.lower(collapsed(text))
    for noise in (HEADER, *MOTTOES):
        low = F.replace(low, F.lit(noise), F.lit(""))
    low, out = F.trim(low), None
    for key, name in ISSUERS:
        out = F.when(low.contains(key), name) if out is None else out.when(low.contains(key), name)
    return F.when(text.isNull() | (low == ""), None).otherwise(out.otherwise(collapsed(text)))


def parsed_date(text: Column) -> Column:
    """ISO date or date-time, d/m/Y, or the long form; anything else is null, never guessed."""
    t = collapsed(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    short = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")).cast("date"))
    parts = [F.regexp_extract(t, r"(?iu)^ngày (\d{1,2}) tháng (\d{1,2}) năm (\d{4})$", i) for i in (1, 2, 3)]
    long = F.when(parts[0] != "", F.try_to_timestamp(F.concat_ws("/", *parts), F.lit("d/M/yyyy")).cast("date"))
    return F.coalesce(iso, short, long)


def document_type(text: Column) -> Column:
    """Type by the first line that starts with a known name; line order goes before name order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.upper(collapsed(x)))

    def kind(line: Column) -> Column:
        out = None
        for prefix, name in TYPE_PREFIXES:
            out = F.when(line.startswith(prefix), name) if out is None else out.when(line.startswith(prefix), name)
        return out

    return F.get(F.filter(F.transform(lines, kind), lambda x: x.isNotNull()), F.lit(0))


def document_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<![\p{L}\p{N}_])(\d{1,4}/\d{4}/[A-ZĐ][A-ZĐ0-9-]*)(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found)


def without_marks(text: Column) -> Column:
    """Lower case without diacritics, but đ stays a letter of its own."""
    return F.regexp_replace(normalised(F.lower(text), "NFD"), r"\p{M}+", "")


def slug(number: Column) -> Column:
    """Document slug of a number: its authority suffix goes, separators become hyphens."""
    return F.regexp_replace(F.regexp_replace(without_marks(number), r"/[a-zđ][a-zđ0-9-]*$", ""), r"[^a-zđ0-9]+", "-")


def reference_text(text: Column) -> Column:
    """Key of an unresolved reference: compatibility form, lower, no punctuation, collapsed."""
    bare = F.regexp_replace(F.lower(normalised(text, "NFKC")), r"""[.,;:!?()\[\]{}"'«»“”‘’…•]+""", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def word_total(text: Column) -> Column:
    t = collapsed(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def is_short_point(kind: Column, text: Column, most: int = 3) -> Column:
    return (kind == "POINT") & (word_total(text) <= most)


def valid_id(provision_id: Column) -> Column:
    return provision_id.rlike(ID_GRAMMAR)


def amount(text: Column) -> Column:
    """Money or count as a decimal: thousand dots, and the unit behind it (``800 nghìn``, ``1,5 triệu đồng``)."""
    pattern = r"(?iu)(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{1,3}))?\s*(nghìn|ngàn|triệu|tỷ|tỉ)?"
    whole, part, unit = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    worth = F.when(F.lower(unit).isin("nghìn", "ngàn"), 1_000).when(F.lower(unit) == "triệu", 1_000_000).when(F.lower(unit).isin("tỷ", "tỉ"), 1_000_000_000).otherwise(1)
    number = F.concat(F.replace(whole, F.lit("."), F.lit("")), F.lit("."), F.rpad(part, 3, "0")).try_cast("decimal(18,3)")
    return F.when(whole != "", (number * worth).try_cast("decimal(18,0)"))


def canonical_json(record: Column) -> Column:
    """JSON text with the fields in the order of the struct (give them sorted), no blanks and nulls kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def manifest_hash(record: Column) -> Column:
    """``sha256:`` and the digest of a manifest's canonical JSON: equal for equal fields, whatever their first order."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(record), 256))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column) -> Column:
    """Key of a cached embedding: parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
