"""Ranks, statuses and vocabularies, and the phonetic form of scientific names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rank, rank id, lowest and highest rank id of the ranks it may stand for, marker.
RANKS = """domain 100 1 1999 dom
realm 700 1 1999 realm
subrealm 800 1 1999 subrealm
superkingdom 900 1 1999 superreg
kingdom 1000 1 1999 reg
subkingdom 1100 1 1999 subreg
infrakingdom 1200 1000 2999 infrareg
superphylum 1900 1001 2999 superphyl
phylum 2000 1001 2999 phyl
subphylum 2100 1001 2999 subphyl
infraphylum 2200 1001 3999 infraphyl
superclass 2900 2001 3999 supercl
class 3000 2001 3999 cl
subclass 3100 2001 3999 subcl
infraclass 3200 2001 4999 infracl
superdivision 3280 2001 4999 superdiv
division 3300 2001 4999 div
subdivision 3320 2001 4999 subdiv
cohort 3500 2001 4999 cohort
superorder 3900 3001 4999 superord
order 4000 3001 4999 ord
suborder 4100 3001 4999 subord
infraorder 4200 4001 5999 infraord
superfamily 4900 4001 5999 superfam
family 5000 4001 5999 fam
subfamily 5100 4001 5999 subfam
tribe 5300 5001 6999 trib
subtribe 5320 5001 6999 subtrib
genus 6000 5001 6999 gen
subgenus 6100 5001 6999 subgen
section 6300 6001 6999 sect
subsection 6320 6001 6999 subsect
series 6400 6001 6999 ser
subseries 6420 6001 6999 subser
aggregate 6600 6001 6999 agg
species 7000 6900 10000 sp
infraspecies 7100 7001 10000 infrasp
subspecies 8000 7000 10000 subsp
convariety 8110 7001 10000 convar
variety 8300 7000 10000 var
subvariety 8320 7000 10000 subvar
form 8400 7000 10000 f
subform 8420 7000 10000 sf
pathovar 8500 7000 10000 pv
biovar 8510 7000 10000 biovar
serovar 8550 7000 10000 serovar
cultivar 8600 7000 10000 cv
strain 8700 7000 10000 strain
other 0 -10000 10000 -
unranked -1 -10000 10000 -"""

# Further markers that are read as ranks.
MORE_MARKERS = ("ssp", "spp", "subf")

# Status, weight, flags (A accepted, S synonym, M misapplied, E excluded, D doubtful, U unreviewed, I inferred), in order.
STATUSES = """accepted 10 A
unreviewed 1 AU
inferredAccepted 2 ASUI
homotypicSynonym 1.5 S
objectiveSynonym 1.5 S
heterotypicSynonym 1 S
subjectiveSynonym 1 S
synonym 1 S
proParteSynonym 1 S
unreviewedSynonym 1 SU
inferredSynonym 1 SUI
misapplied 0.5 M
miscellaneousLiterature 0.5 -
excluded 0.5 E
inferredExcluded 0.1 EUI
invalid 0.1 DUI
inferredInvalid 0.1 DUI
unplaced 0.5 D
inferredUnplaced 0.5 DUI
incertaeSedis 0.1 AD
speciesInquirenda 0.1 AD
unknown 0.5 DUI"""

# Statuses that count as equal; kinds of places whose first is linked with the others.
STATUS_CLASSES = """accepted unreviewed inferredAccepted
synonym unreviewedSynonym inferredSynonym heterotypicSynonym homotypicSynonym objectiveSynonym subjectiveSynonym proParteSynonym
excluded inferredExcluded
unplaced inferredUnplaced incertaeSedis speciesInquirenda
invalid inferredInvalid"""
GEOGRAPHY_CLASSES = """stateProvince country island islandGroup
islandGroup waterBody
other municipality county stateProvince country continent island islandGroup waterBody"""

# Weights of ranks, priorities and index weights of common names, default areas (square kilometres).
RANK_WEIGHTS = {"kingdom": 10.0, "phylum": 2.0, "class": 2.0, "order": 2.0, "family": 5.0, "genus": 10.0, "species": 20.0}
NAME_PRIORITY = {"legislated": 500, "standard": 400, "preferred": 300, "common": 200, "traditionalKnowledge": 200, "local": 100, "deprecated": -1}
NAME_WEIGHTS = {"legislated": 1000.0, "standard": 100.0, "preferred": 20.0, "common": 10.0, "traditionalKnowledge": 20.0, "local": 5.0, "deprecated": 1.0}
AREAS = {"continent": 2e7, "country": 6e5, "stateProvince": 5e4, "island": 1e3, "islandGroup": 1e4, "waterBody": 1e6, "county": 1e3, "municipality": 100.0, "other": 1.0}

# Weights of nomenclatural statuses, 1 unless named.
NOMENCLATURAL_WEIGHTS = {
    0.5: "alternative provisional subnudum orthographic_variant",
    0.2: "doubtful ambiguous confused superfluous",
    0.1: "obscure rejected_proposed rejected_outright_proposed forgotten aborted nudum null_name suppressed rejected_outright rejected illegitimate invalid denied",
}

# Kingdom, code, kingdoms that may stand for it.
KINGDOMS = """Plantae ICBN Viridiplantae,Fungi,Chromista,Protozoa,Protista
Viridiplantae ICBN Plantae,Fungi,Chromista,Protozoa,Protista
Fungi ICBN Plantae,Viridiplantae,Chromista,Protozoa,Protista
Animalia ICZN Chromista,Protozoa,Protista
Virus ICVN -
Bacteria ICNB Archaea,Eubacteria
Archaea ICNB Bacteria,Eubacteria
Eubacteria ICNB Bacteria,Archaea
Chromista ICBN Animalia,Viridiplantae,Plantae,Fungi,Protozoa,Protista
Protozoa ICZN Animalia,Viridiplantae,Plantae,Fungi,Chromista,Protista
Protista ICZN Animalia,Viridiplantae,Plantae,Fungi,Chromista,Protozoa"""

# A word's first letters and what they sound like; then its other letters, in this order.
LEADING = {"AE": "E", "CN": "N", "CT": "T", "CZ": "C", "DJ": "J", "EA": "E", "EU": "U", "GN": "N", "KN": "N", "MC": "MAC", "MN": "N", "OE": "E", "QU": "Q", "PS": "S", "PT": "T", "TS": "S", "WR": "R", "X": "Z"}
INNER = [("AE", "I"), ("IA", "A"), ("OE", "I"), ("OI", "A"), ("SC", "S"), ("E", "I"), ("O", "A"), ("U", "I"), ("Y", "I"), ("K", "C"), ("Z", "C"), ("H", "")]

# Letters with accents by their plain letter; ways to write "in the strict sense" and "in the wide sense", without blanks.
ACCENTED = {"A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖØ", "U": "ÙÚÛÜ"}
SENSES = ("S.S.", "S.STR", "S.STR.", "SENS.STR", "SENS.STR.", "SENSUSTRICTO", "S.L.", "S.LAT", "S.LAT.", "SENS.LAT", "SENS.LAT.", "SENSULATO")

_RANKS = [line.split() for line in RANKS.splitlines()]
MARKERS = "|".join(sorted({m for *_, m in _RANKS if m != "-"} | set(MORE_MARKERS), key=len, reverse=True))


def _lookup(key: Column, values: dict) -> Column:
    """A constant table as one map expression; null for what it lacks."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def ranks(spark: SparkSession) -> DataFrame:
    """rank, rank_id, low, high, marker: the table of ranks."""
    return spark.createDataFrame([(r, int(i), int(a), int(b), None if m == "-" else m) for r, i, a, b, m in _RANKS], "rank string, rank_id int, low int, high int, marker string")


def rank_of(text: Column) -> Column:
    """A rank's name from its name or marker, any case, with or without the dot; null if unknown."""
    names = {r: r for r, *_ in _RANKS} | {m: r for r, *_, m in _RANKS if m != "-"} | {"ssp": "subspecies", "spp": "species", "subf": "subform"}
    return _lookup(F.lower(F.rtrim(F.trim(text), F.lit("."))), names)


def rank_id(rank: Column) -> Column:
    return _lookup(F.lower(rank), {r: int(i) for r, i, *_ in _RANKS})


def rank_within(rank: Column, upper: str, lower: str, unranked: bool = False) -> Column:
    """Whether a rank lies between two (both included); unranked and null ranks only if allowed."""
    ids = {r: int(i) for r, i, *_ in _RANKS}
    known = rank_id(rank)
    return F.when(known.isNull() | (known <= 0), F.lit(unranked)).otherwise(known.between(ids[upper], ids[lower]))


def rank_fidelity(given: Column, actual: Column) -> Column:
    """1 less the distance of two rank ids over 1,000 (4,000 below species), not under 0; null if none is given, 0 if none is there."""
    scale = F.when((given > 7000) & (actual > 7000), 4000.0).otherwise(1000.0)
    return F.when(given.isNull(), None).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(given - actual) / scale), F.lit(0.0)))


def ranks_agree(given: Column, actual: Column) -> Column:
    """Three-valued: null where either is null or unranked, else whether one lies in the range that the other may stand for."""
    low, high = ({r: int(x[k]) for r, *x, _ in _RANKS} for k in (1, 2))
    g, a = rank_id(given), rank_id(actual)
    within = a.between(_lookup(F.lower(given), low), _lookup(F.lower(given), high)) | g.between(_lookup(F.lower(actual), low), _lookup(F.lower(actual), high))
    return F.when(F.lower(given) == F.lower(actual), True).when((g <= 0) | (a <= 0), None).otherwise(within)


def statuses_agree(given: Column, actual: Column) -> Column:
    """Three-valued: whether two statuses are of one class."""
    classes = [line.split() for line in STATUS_CLASSES.splitlines()]
    kind = lambda c: _lookup(c, {s: k for k, names in enumerate(classes) for s in names})
    return F.when(given.isNull() | actual.isNull(), None).otherwise(F.coalesce((given == actual) | (kind(given) == kind(actual)), F.lit(False)))


def geographies_agree(given: Column, actual: Column) -> Column:
    """Three-valued: the same kind of place, or kinds that a class links; only a class's first member is linked with its others."""
    links = {(line.split()[0], x) for line in GEOGRAPHY_CLASSES.splitlines() for x in line.split()[1:]}
    pair = F.concat_ws(" ", F.least(given, actual), F.greatest(given, actual))
    return F.when(given.isNull() | actual.isNull(), None).otherwise((given == actual) | pair.isin([" ".join(sorted(x)) for x in sorted(links)]))


def geography_of(text: Column) -> Column:
    """A kind of place from its name or another word for it; null if unknown."""
    names = {k.lower(): k for k in [*AREAS, "region"]} | dict.fromkeys(("sea", "ocean", "gulf", "bay"), "waterBody")
    return _lookup(F.lower(F.trim(text)), names)


def rank_range(value: Column) -> tuple[Column, Column]:
    """The lowest and highest ids that the rank with the nearest id not above a value may stand for."""
    known = sorted((int(i), int(a), int(b)) for _, i, a, b, _ in _RANKS if int(i) > 0)
    nearest = lambda at: reduce(lambda acc, x: F.when(value >= x[0], x[at]).otherwise(acc), reversed(known[::-1]), F.lit(-10000 if at == 1 else 10000))
    return nearest(1), nearest(2)


def status_order(status: Column) -> Column:
    """A status's place in the vocabulary; unknown statuses and null stand last."""
    return F.coalesce(_lookup(status, {line.split()[0]: k for k, line in enumerate(STATUSES.splitlines())}), F.lit(len(STATUSES.splitlines()) - 1))


def status_is(status: Column, flag: str) -> Column:
    """Whether a status has a flag; null counts as unknown."""
    having = [line.split()[0] for line in STATUSES.splitlines() if flag in line.split()[2]]
    return F.coalesce(status, F.lit("unknown")).isin(having)


def placed(status: Column) -> Column:
    return status_is(status, "A") | status_is(status, "S")


def synonym_like(status: Column) -> Column:
    return ~status_is(status, "A") & (status_is(status, "S") | status_is(status, "M") | status_is(status, "E"))


def kingdom_fidelity(given: Column, actual: Column) -> Column:
    """1 for the same kingdom, 0.5 for one that may stand for it, else 0; null if either is null."""
    others = {k: ([] if o == "-" else o.lower().split(",")) for k, _, o in (line.split() for line in KINGDOMS.splitlines())}
    near = reduce(lambda a, b: a | b, [(F.lower(actual) == k.lower()) & F.lower(given).isin(o) for k, o in others.items() if o])
    return F.when(given.isNull() | actual.isNull(), None).when(F.lower(given) == F.lower(actual), 1.0).when(near, 0.5).otherwise(0.0)


def code_of(kingdom: Column) -> Column:
    """The nomenclatural code that rules a kingdom's names."""
    return _lookup(F.lower(kingdom), {line.split()[0].lower(): line.split()[1] for line in KINGDOMS.splitlines()})


def taxon_weight(priority: Column, rank: Column, status: Column, nomenclatural: Column, override: Column | None = None) -> Column:
    """ln(priority) + 1, by the weights of rank, status and the least of the nomenclatural statuses; not under 1; an override replaces priority."""
    start = F.greatest(priority if override is None else F.coalesce(override, priority), F.lit(1.0))
    weights = {line.split()[0]: float(line.split()[1]) for line in STATUSES.splitlines()}
    by_name = {n: w for w, names in NOMENCLATURAL_WEIGHTS.items() for n in names.split()}
    least = F.array_min(F.transform(nomenclatural, lambda x: F.coalesce(_lookup(F.lower(x), by_name), F.lit(1.0))))
    one = F.lit(1.0)
    return F.greatest(one, (F.log(start) + 1) * F.coalesce(_lookup(F.lower(rank), RANK_WEIGHTS), one) * F.coalesce(_lookup(status, weights), one) * F.coalesce(least, one))


def location_weight(area: Column, kind: Column, boost: Column) -> Column:
    """ln(area / 1000) + 1, not under 1, by a boost; places without an area have their kind's."""
    size = F.coalesce(area, _lookup(kind, AREAS), F.lit(AREAS["other"]))
    return F.greatest(F.lit(1.0), F.log(size / 1000) + 1) * F.coalesce(boost, F.lit(1.0))


def common_name_weight(status: Column, rank: Column, accepted: Column) -> Column:
    """A common name's weight by its status, ten times for species, twice for genera, a tenth for others, a tenth for names not accepted."""
    by_rank = F.when(F.lower(rank) == "species", 10.0).when(F.lower(rank) == "genus", 2.0).otherwise(0.1)
    return F.greatest(F.lit(1.0), F.coalesce(_lookup(status, NAME_WEIGHTS), F.lit(1.0)) * by_rank * F.when(accepted, 1.0).otherwise(0.1))


def common_name_order(status: Column, preferred: Column) -> Column:
    """The order key of common names: their status's priority (common where unknown), 50 more if preferred."""
    return F.coalesce(_lookup(status, NAME_PRIORITY), F.lit(NAME_PRIORITY["common"])) + F.when(F.coalesce(preferred, F.lit(False)), 50).otherwise(0)


def accepts_synonym(accepted_rank: Column, synonym_rank: Column) -> Column:
    """Whether a synonym's name may stand for the accepted record: unranked, both at or below species, or less than 2,000 rank ids apart."""
    a, s = rank_id(accepted_rank), rank_id(synonym_rank)
    return F.coalesce((a <= 0) | (s <= 0) | ((a >= 7000) & (s >= 7000)) | (F.abs(a - s) < 2000), F.lit(True))


def taxon_phonetic(name: Column, rank: Column | None = None, scientific: bool = True, epithet: bool = False) -> Column:
    """The phonetic form of a scientific name: every word by its sound, epithets with one ending; null for blank names.

    Scientific names lose rank markers unless ``nov`` follows; other names keep them, and digits. Words after the first are
    epithets where the rank is null or at or below species.
    """
    bare = lambda w: F.regexp_replace(w, r"\.$", "")
    marker = lambda w: bare(w).isin(*[m.upper() for m in MARKERS.split("|")])

    def said(words: Column, w: Column, i: Column) -> Column:
        """A word as it counts among the others; null if it does not."""
        after, before = F.coalesce(F.get(words, i + 1), F.lit("")), F.coalesce(F.get(words, i - 1), F.lit(""))
        cultivar = lambda k: F.array_join(F.slice(words, k + 1, F.size(words)), " ").rlike(r"""^('[A-Z ]+'|"[A-Z ]+"|\([A-Z ]+\))( |$)""")
        sense = w.isin(*SENSES) | F.concat(w, after).isin(*SENSES) | ((i > 1) & F.concat(before, w).isin(*SENSES))
        new, follows_marker = bare(w) == "NOV", (i > 1) & marker(before)
        inner = F.when(sense, None).when(bare(w) == "AFF", "AFF").when(bare(w).isin("CF", "CFR", "CONF"), "CF")
        inner = inner.when(new & follows_marker, F.when(~cultivar(i + 1), "NOV")).when(marker(w) & (bare(after) == "NOV"), F.when(~cultivar(i + 2), bare(w)))
        if scientific:
            inner = inner.when(marker(w) & ~F.startswith(after, F.lit("NOV")), None)
        return F.when(i == 0, w).otherwise(inner.otherwise(w))

    folded = F.replace(F.translate(F.upper(name), "".join(ACCENTED.values()), "".join(k * len(v) for k, v in ACCENTED.items())), F.lit("Æ"), F.lit("AE"))
    plain = F.filter(F.split(F.regexp_replace(F.replace(folded, F.lit("&AMP;"), F.lit("")), r"<[^>]+>", ""), r"\s+"), lambda w: w != "")
    # The array of words is bound once: inside a lambda an expression is computed anew for each word.
    spoken = F.flatten(F.transform(F.array(plain), lambda words: F.transform(words, lambda w, i: F.regexp_replace(said(words, w, i), "[^A-Z .]" if scientific else "[^A-Z0-9 .]", ""))))
    low = F.lit(True) if rank is None else F.coalesce(rank_id(rank) >= 7000, F.lit(True))

    def sound(w: Column, k: Column) -> Column:
        w = reduce(lambda acc, x: F.when(F.startswith(w, F.lit(x[0])), F.concat(F.lit(x[1]), F.substr(w, F.lit(len(x[0]) + 1)))).otherwise(acc), reversed(LEADING.items()), w)
        rest = reduce(lambda acc, x: F.replace(acc, F.lit(x[0]), F.lit(x[1])), INNER, F.substr(w, F.lit(2)))
        w = F.regexp_replace(F.concat(F.left(w, F.lit(1)), rest), r"(\w)\1+", "$1")
        return F.when(((k > 0) & low) | F.lit(epithet), F.regexp_replace(w, "(IS|IM|AS)$", "A")).otherwise(w)

    words = F.filter(spoken, lambda w: w != "")
    return F.nullif(F.array_join(F.transform(words, sound), " "), F.lit(""))
