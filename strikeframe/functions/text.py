"""String functions over columns: names, keys, links and similarity. All are built-in expressions."""

from __future__ import annotations

from unicodedata import combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin lower-case letters that decompose into one plain letter and marks, and that letter.
FOLDED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and (d := normalize("NFKD", c))[0].isascii() and all(map(combining, d[1:])) and len(d) > 1}
#: Generational suffixes of names.
SUFFIX = r"\b(jr|sr|ii|iii|iv|v)\b\.?$"
#: Parts of page furniture that scrapers have taken for names.
FURNITURE = ["Sports-Statistics", "Fight Statistics", "Odds Calculator", "Scheduled UFC Events", "Privacy Policy", "Contact Us", "BY SPORT", "All SPORTS", "Home > UFC"]


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_key(c: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(c))


def norm_name(c: Column) -> Column:
    """Lower-cased words of letters, digits, hyphen and apostrophe; anything else parts words."""
    return norm_space(F.regexp_replace(norm_key(c), r"[^a-z0-9\s'-]+", " "))


def norm_name_folded(c: Column) -> Column:
    """``norm_name`` after folding accents, in one character or as marks behind the letter."""
    bare = F.translate(norm_key(c), "".join(FOLDED), "".join(FOLDED.values()))
    return norm_name(F.regexp_replace(bare, r"\p{M}+", ""))


def squeeze_name(c: Column) -> Column:
    """Deletes all but letters, digits and spaces, so hyphens and apostrophes join what they parted."""
    return norm_space(F.regexp_replace(norm_key(c), r"[^a-z0-9\s]+", ""))


def strip_suffix(c: Column) -> Column:
    return F.trim(F.regexp_replace(norm_name(c), SUFFIX, ""))


def title_key(c: Column) -> Column:
    """One space between words, each with a capital."""
    return F.initcap(F.lower(norm_space(c)))


def slug(c: Column) -> Column:
    """Runs of other characters become one underscore; none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of a pair."""
    return F.array_join(F.array_sort(F.array(norm_key(a), norm_key(b))), " vs ")


def last_word(c: Column) -> Column:
    return F.element_at(F.split(norm_space(c), " "), -1)


def last_two(c: Column) -> Column:
    words = F.split(norm_space(c), " ")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), F.lit(2)), " ")


def is_furniture(c: Column, shortest: int = 2, longest: int = 60) -> Column:
    """No name: null, too short or long, or page furniture."""
    held = F.exists(F.array(*map(F.lit, FURNITURE)), lambda s: F.contains(F.lower(c), F.lower(s)))
    return c.isNull() | (F.length(F.trim(c)) < shortest) | (F.length(F.trim(c)) > longest) | held


def strip_html(c: Column) -> Column:
    bare = c
    for pattern in (r"(?is)<style.*?</style>", r"(?is)<script.*?</script>", r"(?s)<[^>]+>"):
        bare = F.regexp_replace(bare, pattern, " ")
    return norm_space(bare)


def links(html: Column) -> Column:
    """All link targets, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def url_segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def norm_url(url: Column) -> Column:
    """https, no fragment, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^http://", "https://"), "#.*$", ""), "/+$", "")


def sides_of_slug(c: Column) -> Column:
    """The two names of ``one-name-v-other-name`` or ``-vs-``."""
    parts = F.split(c, "-vs?-")
    return F.when(F.size(parts) == 2, F.transform(parts, lambda s: F.initcap(F.replace(s, F.lit("-"), F.lit(" ")))))


def game_info(c: Column) -> Column:
    """away, home and start of ``A@B MM/dd/yyyy hh:mmAM ET``; null where the text has another form."""
    form = r"^\s*(.+?)\s*@\s*(.+?)\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}[AP]M)(?:\s+ET)?\s*$"
    return F.when(
        c.rlike(form),
        F.struct(
            F.regexp_extract(c, form, 1).alias("away"),
            F.regexp_extract(c, form, 2).alias("home"),
            F.to_timestamp(F.concat_ws(" ", F.regexp_extract(c, form, 3), F.regexp_extract(c, form, 4)), "MM/dd/yyyy hh:mma").alias("start"),
        ),
    )


def label_value(text: Column, label: str, stops: list[str]) -> Column:
    """What follows ``label:`` up to the next of the stop labels; null if the label is missing."""
    form = rf"(?i){label}:\s*(.*?)\s*(?=(?:{'|'.join(stops)}):|$)"
    return F.when(text.rlike(rf"(?i){label}:"), F.regexp_extract(text, form, 1))


def candidate(name: Column, ident: Column, score: Column, reason: Column) -> Column:
    return F.concat_ws(" | ", ident, name, F.format_number(score, 1), reason)


def candidate_id(c: Column) -> Column:
    """The id that opens a candidate's text; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"^\s*([0-9a-f]{16,})\s*\|", 1), F.lit(""))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one row of the usual table at a time."""
    other = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(table: Column, c: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(other.alias("c"), F.slice(table, F.lit(1), F.length(b)).alias("d"), F.slice(table, F.lit(2), F.length(b)).alias("u")),
            F.array(F.lit(0)),
            lambda done, x: F.concat(done, F.array(F.when(x["c"] == c, x["d"] + 1).otherwise(F.greatest(x["u"], F.element_at(done, -1))))),
        )

    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), start, row), -1)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * common subsequence / sum of lengths, words in order of the alphabet; 0 for two empty texts."""
    x, y = (F.array_join(F.array_sort(tokens(c)), " ") for c in (a, b))
    both = F.length(x) + F.length(y)
    return F.when(both == 0, F.lit(0.0)).otherwise(200.0 * common_subsequence(x, y) / both)


def sorted_tokens(c: Column) -> Column:
    """The words in order of the alphabet."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def sorted_letters(c: Column) -> Column:
    """The characters of ``sorted_tokens`` in order, numbered by occurrence, so that they make a set."""
    letters = F.array_sort(F.filter(F.split(sorted_tokens(c), ""), lambda x: x != ""))
    return F.transform(F.array(letters), lambda ls: F.transform(ls, lambda x, i: F.concat(x, (i - F.array_position(ls, x) + 1).cast("string"))))[0]


#: What normal names are made of, and the longest of them whose rows of bits fit a number without its sign and carry.
NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 '-"
LONGEST_ROW = 60


def letter_rows(c: Column) -> Column:
    """For each of NAME_CHARACTERS the places of ``sorted_tokens`` that have it, as bits; null for longer names."""
    text = sorted_tokens(c)
    rows = [F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0).cast("long"), _placed(text, x)) for x in NAME_CHARACTERS]
    return F.when(F.length(text).between(1, LONGEST_ROW), F.array(*rows))


def _placed(text: Column, x: str):
    return lambda bits, i: bits.bitwiseOR(F.when(F.substring(text, i, F.lit(1)) == x, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))


def letter_places(c: Column) -> Column:
    """Each character of ``sorted_tokens`` as its place among NAME_CHARACTERS, from 0."""
    return F.transform(F.filter(F.split(sorted_tokens(c), ""), lambda x: x != ""), lambda x: F.call_function("instr", F.lit(NAME_CHARACTERS), x) - 1)


def subsequence_of(a: Column, b: Column, rows: Column, places: Column) -> Column:
    """Length of the longest common subsequence of two normal names' sorted words, by ``letter_rows`` of the first and
    ``letter_places`` of the second: a row of the usual table is one number, a bit for each place where it doesn't grow."""
    size = F.length(sorted_tokens(a))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def step(bits: Column, place: Column) -> Column:
        return F.transform(F.array(bits.bitwiseAND(F.get(rows, place))), lambda u: (bits + u).bitwiseOR(bits - u).bitwiseAND(full))[0]

    short = size - F.bit_count(F.aggregate(places, full, step))
    return F.when(rows.isNotNull(), short).otherwise(common_subsequence(sorted_tokens(a), sorted_tokens(b)))


def salted_hash(salt: Column, secret: Column) -> Column:
    return F.concat(salt, F.lit("$"), F.sha2(F.concat(salt, F.lit(":"), secret), 256))
