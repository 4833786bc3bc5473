"""Scientific names: markers, comments and placeholders found and rewritten, parts parsed, authors in one form.

Every step is column expressions. ``analyse`` chains them over a DataFrame; each step may add an issue and change the name.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.functions.strings import unicode_form
from credal.functions.taxonomy import MARKERS, rank_of

# Comments that are dropped from names, and texts that are no names.
COMMENTS = (
    r"\[[^\]]+\]", r"(^|\s+)hybrid($|\s+)", r"\((?:genus|family|order|class|phylum|kingdom)\)", r"\*\*non-current code\*\*", r"\(NC\)",
    r"(?:-\s*)?undifferentiated", r"^\*$", r"\(?Unmatched taxon\)?", r"\(unverified\)",
)
INVALID = (
    r"\*", "Flora", "Incertae Sedis", "Invalid", "Misc .*", "Miscellaneous .*", "Kingdom", "Subkingdom", "Superphylum", "Phylum", "Subphylum", "Superclass", "Class", "Subclass",
    "Superorder", "Order", "Suborder", "Superfamily", "Family", "Subfamily", "Genus", "Genus sp.", "Subgenus", "Species", "Subspecies",
)

# Markers of species and below.
LOW_MARKERS = ("sp", "subsp", "ssp", "var", "subvar", "subf", "f", "cv", "infrasp", "convar")
# Words for "compare" and "new".
CONFER = ("cf", "cfr", "conf")
NEW = ("nov", "nov.", "novum")


def unquoted(c: Column) -> Column:
    """Without the pairs of quotation marks around the whole text, however many; blanks between them go too."""
    c = F.trim(c)
    marks = lambda run: F.regexp_replace(F.regexp_extract(c, run, 1), r"\s", "")
    ahead, behind = marks(r"""^(["'\s]*)"""), F.reverse(marks(r"""(["'\s]*)$"""))
    least = F.least(F.length(ahead), F.length(behind))
    pairs = F.size(F.filter(F.sequence(F.lit(0), least), lambda k: (k > 0) & (F.left(ahead, k) == F.left(behind, k))))
    around = F.concat(F.lit(r"""^(?:\s*["']){"""), pairs, F.lit(r"""}|(?:["']\s*){"""), pairs, F.lit("}$"))
    return F.when(pairs > 0, F.trim(F.regexp_replace(c, around, F.lit("")))).otherwise(c)


def printable(c: Column, replacement: str = "") -> Column:
    """Replacement characters (U+FFFD) replaced."""
    return F.replace(c, F.lit("�"), F.lit(replacement))


def alternating(c: Column) -> Column:
    """A map of rank to name for texts that alternate both ("genus X species y") throughout; else null."""
    pair = rf"(?i)\s*({MARKERS}|genus|species|family|order|class|phylum|kingdom)\.?\s+([A-Za-z][a-z]+)"
    found = F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(1)), rank_of).alias("rank"), F.regexp_extract_all(c, F.lit(pair), F.lit(2)).alias("name"))
    whole = c.rlike(rf"^({pair}(?=\s|$))+\s*$")
    unique = F.filter(found, lambda x: x["rank"].isNotNull())
    last = F.aggregate(unique, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["rank"]), F.create_map(x["rank"], x["name"])))
    return F.when(whole & (F.size(unique) > 0), last)


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "")


def _letter(word: Column, first: Column) -> Column:
    """What a word is, as one letter: s marker of a species or below, m other marker, a affinity, c confer, n new, N capital word, L capital letter,
    D digits, C other word with a capital, e epithet, w other word, ( bracket, o anything else. The first word is no marker."""
    bare = _bare(word)
    table = [
        (~first & bare.isin(*LOW_MARKERS), "s"), (~first & bare.isin(*MARKERS.split("|")), "m"), (~first & (bare == "aff"), "a"), (~first & bare.isin(*CONFER), "c"),
        (word.isin(*NEW), "n"), (word.rlike("^[A-Z][a-z]+$"), "N"), (word.rlike("^[A-Z]$"), "L"), (word.rlike("^[0-9]+$"), "D"), (word.rlike("^[A-Z][A-Za-z0-9'-]*$"), "C"),
        (word.rlike("^[a-z-]+$"), "e"), (word.rlike("^[A-Za-z0-9'-]+$"), "w"), (F.startswith(word, F.lit("(")), "("),
    ]
    return reduce(lambda other, x: F.when(x[0], x[1]).otherwise(other), reversed(table), F.lit("o"))


def _letters(words: Column) -> Column:
    """The letters of all words; a single word may be a marker."""
    return F.array_join(F.transform(words, lambda w, i: _letter(w, (i == 0) & (F.size(words) > 1))), "")


#: A name's kind by the letters of its words. New species, phrase names and what is like them keep their markers.
_SHAPES = {"new species": "[sm]n", "phrase name": r"^Ne?[sm][NCL][NCLDew]*\(", "phrase-like name": "^NsN+$", "rank ending": "[sm]$", "code placeholder": "^N[sm][LD]", "rank marker": "[sm]."}


def analyse(df: DataFrame, column: str, canonical: bool = True) -> DataFrame:
    """Adds name, rank, kind and issues for the text in ``column``; with ``canonical`` false issues are found and names stay.

    kind: scientific, phrase, placeholder, informal or invalid; null texts and blank ones have a null name and no issue. Comments and question
    marks go first. Then each word is given a letter, and the letters of the whole name say what it is and which words stay, go or are
    written in one form. Columns of any name are kept, but name, rank, kind and issues.
    """
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    kept = [c for c in df.columns if c not in ("name", "rank", "kind", "issues")]
    comments = f"(?i)(?:{'|'.join(COMMENTS)})"
    out = df.select(F.struct(*kept).alias("row"), tidy(printable(unquoted(F.col(column)))).alias("text")).withColumn("plain", tidy(F.regexp_replace("text", comments, " ")))
    out = out.withColumn("plain", tidy(F.translate("plain", "?", " "))).withColumn("words", F.split("plain", " "))
    # A bracket begins a word of its own where a name's shape is read.
    out = out.withColumn("shape", F.coalesce(_letters(F.col("words")), F.lit(""))).withColumn("spaced", F.coalesce(_letters(F.split(tidy(F.replace("plain", F.lit("("), F.lit(" ("))), " ")), F.lit("")))
    is_, text = lambda k: F.col("shape").rlike(_SHAPES[k]), F.coalesce(F.col("text"), F.lit(""))
    novel = is_("new species")
    phrase = ~novel & F.col("spaced").rlike(_SHAPES["phrase name"]) & F.col("plain").rlike(r"\([^)]+\)")
    like = is_("phrase-like name") & ~phrase
    open_ = ~(novel | phrase | like)
    code = open_ & is_("code placeholder")
    found = {
        "comment": text.rlike(comments), "indeterminate": F.contains(text, F.lit("?")), "affinity": F.contains("shape", F.lit("a")), "confer": F.contains("shape", F.lit("c")), "new species": novel,
        "phrase name": phrase, "phrase-like name": like, "rank ending": open_ & is_("rank ending"), "code placeholder": code, "rank marker": open_ & ~code & is_("rank marker"),
    }
    out = out.withColumn("found", F.struct(*[hit.alias(k) for k, hit in found.items()]))
    hit = lambda k: F.col(f"found.`{k}`")

    letter = lambda i: F.substring(F.col("shape"), i + 1, F.lit(1))

    def written(word: Column, i: Column) -> Column:
        marker, last = letter(i).isin("s", "m"), i == F.size("words") - 1
        gone = marker & F.when(last, hit("rank ending")).otherwise(hit("rank marker"))
        new = hit("new species") & marker & (letter(i + 1) == "n")
        return F.when(gone, None).when(letter(i) == "a", "aff.").when(letter(i) == "c", "cf.").when(new, F.concat(_bare(word), F.lit("."))).when(hit("new species") & (letter(i) == "n") & (i > 0) & letter(i - 1).isin("s", "m"), "nov.").otherwise(word)

    if canonical:
        out = out.withColumn("text", F.nullif(F.array_join(F.transform("words", written), " "), F.lit("")))
    place = F.regexp_instr(F.when(hit("new species"), F.regexp_replace("shape", "[sm](?!n)", "-")).otherwise(F.col("shape")), F.lit("[sm]"))
    ranked = F.when(place > 0, rank_of(F.get("words", place - 1)))
    by_marker = hit("new species") | hit("phrase name") | hit("phrase-like name") | hit("code placeholder") | hit("rank marker")
    invalid = F.coalesce(F.col("text").rlike(rf"(?i)^(?:{'|'.join(INVALID)})$"), F.lit(False))
    informal = hit("indeterminate") | hit("affinity") | hit("confer") | hit("rank ending")
    kind = F.when(invalid, "invalid").when(hit("code placeholder") | hit("phrase-like name"), "placeholder").when(hit("phrase name"), "phrase").when(informal, "informal").otherwise("scientific")
    issues = F.filter(F.array(*[F.when(hit(k), k) for k in found], F.when(invalid, "invalid")), lambda x: x.isNotNull())
    return out.select("row.*", F.col("text").alias("name"), F.when(by_marker, ranked).when(hit("rank ending"), "unranked").alias("rank"), kind.alias("kind"), issues.alias("issues"))


def parts(c: Column) -> Column:
    """uninomial or genus, subgenus, specific, infraspecific, cultivar and authorship of a name; parts that are not there are null.

    A name is a capital word, perhaps a subgenus in brackets, up to two epithets in lower case (rank markers between are skipped), perhaps a
    cultivar in quotes; what follows is the authorship. Texts that do not begin with a capital word have no parts.
    """
    epithet = rf"(?:(?:{MARKERS})\.\s+)?([a-zà-ÿ][a-zà-ÿ-]+)(?![.\w])"
    whole = rf"^([A-ZÀ-Þ][a-zà-ÿ-]+)(?:\s+\(([A-Z][a-z]+)\))?(?:\s+{epithet})?(?:\s+{epithet})?(?:\s+'([^']+)')?(?:\s+(.+))?$"
    got = lambda k: F.nullif(F.regexp_extract(c, whole, k), F.lit(""))
    return F.struct(*[got(k + 1).alias(n) for k, n in enumerate(("genus", "subgenus", "specific", "infraspecific", "cultivar", "authorship"))])


def canonical_name(c: Column) -> Column:
    """A name's words without authorship, subgenus and markers; the text itself where it has no parts."""
    p = parts(c)
    return F.when(p["genus"].isNull(), c).otherwise(F.concat_ws(" ", p["genus"], p["specific"], p["infraspecific"], F.when(p["cultivar"].isNotNull(), F.concat(F.lit("'"), p["cultivar"], F.lit("'")))))


def base_names(c: Column) -> Column:
    """The distinct forms under which a name may be looked up: itself, its canonical form, and the species of an infraspecific name."""
    p = parts(c)
    species = F.when(p["infraspecific"].isNotNull(), F.concat_ws(" ", p["genus"], p["specific"]))
    return F.array_distinct(F.filter(F.array(c, canonical_name(c), species), lambda x: x.isNotNull()))


def trinomial(c: Column) -> Column:
    """Genus, epithet and repeated or second epithet without its marker; null for other names."""
    p = parts(c)
    return F.when(p["infraspecific"].isNotNull(), F.concat_ws(" ", p["genus"], p["specific"], p["infraspecific"]))


def authorship(c: Column, abbreviations: Mapping[str, str] | None = None) -> Column:
    """An authorship in one form: the first author's surname, the second's or ``+`` for "et al.", ``+`` for more, then the year.

    The combining authors count, else those in brackets; of "A ex B" B counts. Surnames lose initials, accents, dashes and dots.
    ``abbreviations`` gives surnames for abbreviated ones ("L."). Null, blank and "-" are null.
    """
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\?", ""), r"\(\s*ex\s+", "("))
    outside = F.trim(F.regexp_replace(c, r"\([^)]*\)", " "))
    inside = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    used = F.when(outside != "", outside).otherwise(inside)
    used = F.regexp_replace(used, r"^.*\sex\s+", "")
    year = F.nullif(F.regexp_extract(used, r"\b([12]\d{3})\b", 1), F.lit(""))
    names = F.regexp_replace(F.regexp_replace(used, r",?\s*\b[12]\d{3}[a-z]?\b", ""), r"\s+et\s+al\.?", ", al.")
    split = F.filter(F.transform(F.split(names, r"\s*(?:,|&|\band\b|\bet\b)\s*"), F.trim), lambda x: x != "")
    known = F.create_map(*[F.lit(x) for pair in (abbreviations or {"": ""}).items() for x in pair])

    def surname(x: Column) -> Column:
        last = F.trim(F.regexp_replace(x, r"^(?:[A-ZÀ-Þ][a-zà-ÿ]?\.[\s-]*)+(?=[A-ZÀ-Þa-z])", ""))
        return F.when(x == "al.", F.lit("+")).otherwise(F.coalesce(F.element_at(known, x), F.element_at(known, last), F.regexp_replace(F.replace(last, F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{M} ]", "")))

    first = F.transform(F.slice(split, 1, 2), surname)
    text = F.concat_ws(" ", first, F.when(F.size(split) > 2, F.lit("+")), year)
    return F.when(c.isNull() | c.isin("", "-"), None).otherwise(F.nullif(unicode_form(text, "NFD", True), F.lit("")))


def searchable(c: Column) -> Column:
    """A common name in capitals without anything but A to Z."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def lcs_likeness(a: Column, b: Column) -> Column:
    """1 less the insertions and deletions between two texts over the longer length: the longest common subsequence by one fold over positions.

    The row of the dynamic programme is an array; 1 for two empty texts, null if either is null.
    """
    la, lb = F.length(a), F.length(b)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def row(above: Column, x: Column) -> Column:
        def cell(acc: Column, k: Column) -> Column:
            here = F.when(F.substring(b, k, F.lit(1)) == x, F.get(above, k - 1) + 1).otherwise(F.greatest(F.get(above, k), F.element_at(acc, -1)))
            return F.array_append(acc, here)

        return F.when(lb == 0, above).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(lb, F.lit(1))), F.array(F.lit(0)), cell))

    common = F.element_at(F.aggregate(chars(a), F.array_repeat(F.lit(0), lb + 1), row), -1)
    longest = F.greatest(la, lb)
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, 1.0).otherwise(1 - (la + lb - 2 * common) / longest)


def identifier(text: str, style: str = "camel") -> str:
    """A name as a camel, Pascal, underscore or dash identifier; a leading digit has an underscore before it."""
    import re

    words = [w for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", text) if w]
    joined = {"underscore": "_".join(w.lower() for w in words), "dash": "-".join(w.lower() for w in words)}.get(style)
    if joined is None:
        big = "".join(w[:1].upper() + w[1:] for w in words)
        joined = big if style == "pascal" else big[:1].lower() + big[1:]
    return f"_{joined}" if joined[:1].isdigit() else joined


def uri_tail(uri: str) -> str:
    """The id that a URI ends with: after the last slash, hash or colon."""
    return uri.rstrip("/#").replace("#", "/").replace(":", "/").rsplit("/", 1)[-1]
