"""Version orders: semantic, PEP 440 and RPM, as keys.

A key is a column made of one version alone. PEP 440 and RPM keys are strings whose order, byte by byte, is that of the
versions; so versions are compared, sorted, joined and cut into ranges without looking at pairs. The semantic order
isn't one (1.2.3 equals 1.2.3.4 and 1.2.3.5): its keys are arrays, compared as far as both go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMANTIC = ("npm", "crates.io", "go")


def semver_key(version: Column) -> Column:
    """Leading v's go, a pre-release or build suffix goes, what isn't a number is 0; three parts at least."""
    core = F.regexp_replace(F.regexp_replace(version, "^v+", ""), "(?s)[-+].*$", "")
    parts = F.transform(F.split(core, r"\."), lambda x: F.coalesce(_as_long(x), F.lit(0).cast("long")))
    return F.concat(parts, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), 3 - F.size(parts))))


def _as_long(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(x).cast("long"))


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the parts that both have: 1.2.3 equals 1.2.3.4."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def compare_semver(a: Column, b: Column) -> Column:
    return compare_keys(semver_key(a), semver_key(b))


def _number_key(digits: Column) -> Column:
    """Digits as a string in order of value: how many there are without leading zeros, and they."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: A PEP 440 version: epoch, release, pre-release letter and number, post-release (by hyphen; letter and number), dev
#: letter and number, local segments. The form is the one that the PEP gives in its appendix.
PEP440 = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?(?:[-_.]?(dev)[-_.]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
EPOCH, RELEASE, PRE, PRE_N, POST_N1, POST, POST_N2, DEV, DEV_N, LOCAL = range(10)


def pep440_key(version: Column | str) -> Column:
    """A string in PEP 440's order; null for what is no such version.

    Parts in turn: epoch; release without trailing zeros, each number after a 1, a 0 at the end; pre-release (0 before
    all for a dev release of nothing else, 9 for none); post (0 for none); dev (9 for none); local segments (numbers
    after words, 0 for none and at the end). A word ends in '!', which comes before letters and digits.
    """
    version = F.col(version) if isinstance(version, str) else version
    told = F.split(F.lower(F.regexp_replace(version, PEP440, "|".join(f"${i + 1}" for i in range(10)))), r"\|")

    def key(x: Column) -> Column:
        at = lambda i: F.get(x, F.lit(i))
        number = lambda i: _number_key(F.when(at(i) == "", "0").otherwise(at(i)))
        release = F.split(F.regexp_replace(at(RELEASE), r"(\.0+)+$", ""), r"\.")
        post = (at(POST) != "") | (at(POST_N1) != "")
        letter = F.when(at(PRE).isin("a", "alpha"), "1").when(at(PRE).isin("b", "beta"), "2").otherwise("3")
        pre = F.when(at(PRE) != "", F.concat(letter, number(PRE_N))).when(~post & (at(DEV) != ""), "0").otherwise("9")
        after = F.when(post, F.concat(F.lit("1"), F.when(at(POST_N1) != "", number(POST_N1)).otherwise(number(POST_N2)))).otherwise("0")
        dev = F.when(at(DEV) != "", F.concat(F.lit("0"), number(DEV_N))).otherwise("9")
        segment = lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("2"), _number_key(s))).otherwise(F.concat(F.lit("1"), s, F.lit("!")))
        local = F.when(at(LOCAL) != "", F.concat(F.lit("1"), F.array_join(F.transform(F.split(at(LOCAL), "[-_.]"), segment), ""), F.lit("0"))).otherwise("0")
        numbers = F.array_join(F.transform(release, lambda d: F.concat(F.lit("1"), _number_key(d))), "")
        return F.concat(number(EPOCH), numbers, F.lit("0"), pre, after, dev, local)

    return F.when(version.rlike(PEP440), _bound(told, key))


def _order(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def compare_pep440(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; null where one of the two is no PEP 440 version."""
    return _order(pep440_key(a), pep440_key(b))


def compare(a: Column, b: Column, ecosystem: Column) -> Column:
    """-1, 0 or 1 in the ecosystem's order: PEP 440 for pypi (the semantic one where that can't parse), else semantic."""
    pypi = F.when(ecosystem == "pypi", compare_pep440(a, b))
    return F.coalesce(pypi, compare_semver(a, b))


def is_vulnerable(version: Column, introduced: Column, fixed: Column, ecosystem: Column | None = None) -> Column:
    """introduced <= version < fixed; an empty bound is open, two empty ones are no range. No ecosystem: semantic."""
    order = (lambda a, b: compare(a, b, ecosystem)) if ecosystem is not None else compare_semver
    low, high = F.coalesce(introduced, F.lit("")), F.coalesce(fixed, F.lit(""))
    in_low = (low == "") | (order(version, low) >= 0)
    in_high = (high == "") | (order(version, high) < 0)
    return F.coalesce((version != "") & ((low != "") | (high != "")) & in_low & in_high, F.lit(False))


def within(key: Column, low: Column, high: Column) -> Column:
    """``is_vulnerable`` on keys made before a join (``semver_key``); a null key is an empty bound, or no version."""
    some = key.isNotNull() & (low.isNotNull() | high.isNotNull())
    return some & (low.isNull() | (compare_keys(key, low) >= 0)) & (high.isNull() | (compare_keys(key, high) < 0))


def bound_key(version: Column) -> Column:
    """The semantic key of a version or bound; null for none."""
    return F.when(F.coalesce(version, F.lit("")) != "", semver_key(version))


def rpm_evr(version: Column, release: Column, epoch: Column) -> Column:
    """epoch:version-release; an epoch of 0 or an empty release is left out."""
    body = F.concat(version, F.when(F.coalesce(release, F.lit("")) != "", F.concat(F.lit("-"), release)).otherwise(""))
    return F.concat(F.when(F.coalesce(epoch, F.lit(0)) != 0, F.concat(epoch.cast("string"), F.lit(":"))).otherwise(""), body)


def _segments_key(text: Column) -> Column:
    """Runs of digits and of letters in order: numbers (after a 1) before letters (after a 2), a 0 at the end.

    A segment that is missing is 0: so trailing zeros go, and the end comes before all else.
    """
    runs = F.array_join(F.regexp_extract_all(text, F.lit(r"(\d+|[a-zA-Z]+)"), F.lit(1)), ".")
    told = F.filter(F.split(F.regexp_replace(runs, r"(?:^|\.)0+(?:\.0+)*$", ""), r"\."), lambda s: s != "")
    keyed = F.transform(told, lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("1"), _number_key(s))).otherwise(F.concat(F.lit("2"), s, F.lit("!"))))
    return F.concat(F.array_join(keyed, ""), F.lit("0"))


def rpm_key(evr: Column) -> Column:
    """A string in the order of [epoch:]version[-release]: epochs by number (no number: 0), then versions, then releases."""
    told = F.coalesce(_as_long(F.substring_index(evr, ":", 1)), F.lit(0).cast("long"))
    epoch = F.when(evr.contains(":"), told).otherwise(F.lit(0).cast("long")).cast("decimal(20,0)") + F.lit(10**18).cast("decimal(20,0)")
    rest = F.when(evr.contains(":"), F.regexp_replace(evr, "(?s)^[^:]*:", "")).otherwise(evr)
    release = F.when(rest.contains("-"), F.regexp_replace(rest, "(?s)^[^-]*-", "")).otherwise("")
    return F.concat(F.lpad(epoch.cast("string"), 20, "0"), _segments_key(F.substring_index(rest, "-", 1)), _segments_key(release))


def compare_rpm(a: Column, b: Column) -> Column:
    """-1, 0 or 1: epochs, then the segments of the version, then those of the release; a missing segment is 0."""
    return _order(rpm_key(a), rpm_key(b))


def os_package_vulnerable(version: Column, fixed: Column, manager: Column, version_keys: Column | None = None, fixed_keys: Column | None = None) -> Column:
    """Below the fixed version, or without one. apk and dpkg: PEP 440 where both parse, else by characters.

    Keys, if given, are structs of pep (``pep440_key``) and rpm (``rpm_key``), made before the two sides meet.
    """
    keys = lambda v, given: (pep440_key(v), rpm_key(v)) if given is None else (given["pep"], given["rpm"])
    (pep, rpm), (fixed_pep, fixed_rpm) = keys(version, version_keys), keys(fixed, fixed_keys)
    other = F.coalesce(_order(pep, fixed_pep), F.when(version < fixed, -1).otherwise(0))
    below = F.when(manager == "rpm", _order(rpm, fixed_rpm) < 0).otherwise(other < 0)
    return F.when(F.coalesce(fixed, F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(below, F.lit(True)))


#: Debian code names by version.
DEBIAN_RELEASES = {"buster": "10", "bullseye": "11", "bookworm": "12", "trixie": "13"}


def os_version_key(family: Column, version: Column) -> Column:
    """The version that advisories are filed under: two parts for alpine and ubuntu, the first one for the others."""
    from palisark.dims import literal_map

    named = F.when(family == "debian", F.try_element_at(literal_map(DEBIAN_RELEASES), version))
    two = F.substring_index(version, ".", 2)
    return F.coalesce(named, F.when(family.isin("alpine", "ubuntu"), two).otherwise(F.substring_index(version, ".", 1)))
