"""License scan by ordered signature rules.

Rules are regular expressions over ASCII-lowered UTF-8 bytes. A rule runs only on texts that hold its
keyword. Detections are taken in order of priority, then length, then place; one that lies inside a
detection already taken is suppressed, so a grant or identifier hides the bare name inside it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))
BASE_SCORE = 0.6

# label, keyword, name pattern ("_" stands for white space or a hyphen, "_?" for none or more, "#v" for an optional version word)
NAMES = (
    ("mit", "mit", r"(?:the_)?mit(?:_\(expat\))?_licen[sc]e"),
    ("mit-0", "mit", r"mit_no_attribution(?:_licen[sc]e)?"),
    ("x11", "x11", r"x11_licen[sc]e"),
    ("apache-1.1", "apache", r"apache(?:_software)?_licen[sc]e,?_#v1\.1"),
    ("apache-2.0", "apache", r"apache(?:_software)?_licen[sc]e,?_#v2(?:\.0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2_clause|two_clause)_bsd(?:_licen[sc]e)?|bsd_2_clause(?:_licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3_clause|three_clause)_bsd(?:_licen[sc]e)?|bsd_3_clause(?:_licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4_clause|four_clause)_bsd(?:_licen[sc]e)?|bsd_4_clause(?:_licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:zero_clause_bsd|0bsd|bsd_zero_clause)(?:_licen[sc]e)?"),
    ("bsd", "bsd", r"bsd_(?:style_)?licen[sc]e"),
    ("isc", "isc", r"isc_licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)?_licen[sc]e"),
    ("libpng", "libpng", r"libpng_licen[sc]e"),
    ("boost-1.0", "boost", r"boost_software_licen[sc]e(?:,?_#v1\.0)?"),
    ("unlicense", "unlicense", r"the_unlicense"),
    ("wtfpl", "public", r"do_what_the_f\w+_you_want_to_public_licen[sc]e"),
    ("gpl-1.0", "general", r"gnu_general_public_licen[sc]e,?_#v1(?:\.0)?"),
    ("gpl-2.0", "general", r"gnu_general_public_licen[sc]e,?_#v2(?:\.0)?"),
    ("gpl-3.0", "general", r"gnu_general_public_licen[sc]e,?_#v3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu_)?gpl,?_?#v2(?:\.0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu_)?gpl,?_?#v3(?:\.0)?"),
    ("lgpl-2.0", "general", r"gnu_(?:lesser|library)_general_public_licen[sc]e,?_#v2(?:\.0)?"),
    ("lgpl-2.1", "lesser", r"gnu_lesser_general_public_licen[sc]e,?_#v2\.1"),
    ("lgpl-3.0", "lesser", r"gnu_lesser_general_public_licen[sc]e,?_#v3(?:\.0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu_)?lgpl,?_?#v2\.1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu_)?lgpl,?_?#v3(?:\.0)?"),
    ("agpl-3.0", "affero", r"gnu_affero_general_public_licen[sc]e(?:,?_#v3(?:\.0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu_)?agpl,?_?#v3(?:\.0)?"),
    ("gfdl-1.1", "documentation", r"gnu_free_documentation_licen[sc]e,?_#v1\.1"),
    ("gfdl-1.2", "documentation", r"gnu_free_documentation_licen[sc]e,?_#v1\.2"),
    ("gfdl-1.3", "documentation", r"gnu_free_documentation_licen[sc]e,?_#v1\.3"),
    ("mpl-1.0", "mozilla", r"mozilla_public_licen[sc]e,?_#v1\.0"),
    ("mpl-1.1", "mozilla", r"mozilla_public_licen[sc]e,?_#v1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla_public_licen[sc]e,?_#v2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse_public_licen[sc]e,?_#v1(?:\.0)?"),
    ("epl-2.0", "eclipse", r"eclipse_public_licen[sc]e,?_#v2(?:\.0)?"),
    ("edl-1.0", "eclipse", r"eclipse_distribution_licen[sc]e,?_#v1(?:\.0)?"),
    ("cddl-1.0", "distribution", r"common_development_and_distribution_licen[sc]e(?:,?_#v1\.0)?"),
    ("cddl-1.1", "distribution", r"common_development_and_distribution_licen[sc]e,?_#v1\.1"),
    ("cpl-1.0", "common", r"common_public_licen[sc]e(?:,?_#v1\.0)?"),
    ("cpal-1.0", "attribution", r"common_public_attribution_licen[sc]e(?:,?_#v1\.0)?"),
    ("eupl-1.1", "european", r"european_union_public_licen[sc]e,?_#v1\.1"),
    ("eupl-1.2", "european", r"european_union_public_licen[sc]e,?_#v1\.2"),
    ("artistic-1.0", "artistic", r"artistic_licen[sc]e,?_#v1(?:\.0)?"),
    ("artistic-2.0", "artistic", r"artistic_licen[sc]e,?_#v2(?:\.0)?"),
    ("ms-pl", "microsoft", r"microsoft_public_licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft_reciprocal_licen[sc]e"),
    ("osl-3.0", "open", r"open_software_licen[sc]e,?_#v3(?:\.0)?"),
    ("afl-3.0", "academic", r"academic_free_licen[sc]e,?_#v3(?:\.0)?"),
    ("ofl-1.1", "font", r"sil_open_font_licen[sc]e(?:,?_#v1\.1)?"),
    ("python-2.0", "python", r"python_software_foundation_licen[sc]e(?:,?_#v2(?:\.0)?)?"),
    ("php-3.01", "php", r"php_licen[sc]e,?_#v3\.01"),
    ("ruby", "ruby", r"ruby_licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql_licen[sc]e"),
    ("openssl", "openssl", r"openssl_licen[sc]e"),
    ("vim", "vim", r"vim_licen[sc]e"),
    ("ncsa", "ncsa", r"university_of_illinois/ncsa_open_source_licen[sc]e"),
    ("upl-1.0", "universal", r"universal_permissive_licen[sc]e(?:,?_#v1\.0)?"),
    ("qpl-1.0", "public", r"q_public_licen[sc]e(?:,?_#v1\.0)?"),
    ("lppl-1.3", "latex", r"latex_project_public_licen[sc]e(?:,?_#v1\.3\w?)?"),
    ("bsl-1.1", "business", r"business_source_licen[sc]e(?:,?_#v1\.1)?"),
    ("sspl-1.0", "server", r"server_side_public_licen[sc]e(?:,?_#v1(?:\.0)?)?"),
    ("odbl-1.0", "database", r"open_(?:data_commons_open_)?database_licen[sc]e(?:,?_#v1\.0)?"),
    ("odc-by-1.0", "commons", r"open_data_commons_attribution_licen[sc]e(?:,?_#v1\.0)?"),
    ("pddl-1.0", "public", r"public_domain_dedication_and_licen[sc]e(?:,?_#v1\.0)?"),
    ("cc0-1.0", "cc0", r"cc0(?:_1\.0)?(?:_universal)?"),
)
# Creative Commons terms, written out and short, each in every version
TERMS = (
    ("by", "attribution"), ("by-sa", "attribution_share_?alike"), ("by-nc", "attribution_non_?commercial"),
    ("by-nd", "attribution_no_?deriv(?:ative)?s"), ("by-nc-sa", "attribution_non_?commercial_share_?alike"),
    ("by-nc-nd", "attribution_non_?commercial_no_?deriv(?:ative)?s"),
)
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GRANTS = r"(?:licen[sc]ed|released|distributed|provided|published|shared|made_available|available|redistributed?)"
LINKS = (
    ("apache-2.0", "apache.org", r"apache\.org/licen[sc]es/licen[sc]e_2\.0"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit\b"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl"),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/lgpl"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en_us/)?mpl/2\.0"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl_2\.0"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("boost-1.0", "boost.org", r"boost\.org/licen[sc]e_1_0"),
)
TEXTS = (
    ("mit", "permission", r"permission_is_hereby_granted,_free_of_charge,_to_any_person_obtaining_a_copy"),
    ("isc", "permission", r"permission_to_use,_copy,_modify,_and/?(?:or)?_distribute_this_software_for_any_purpose"),
    ("bsd", "redistribution", r"redistribution_and_use_in_source_and_binary_forms,_with_or_without_modification"),
    ("gpl", "redistribute", r"you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_gnu_general_public_licen[sc]e"),
    ("apache-2.0", "apache", r"you_may_not_use_this_file_except_in_compliance_with_the_licen[sc]e"),
    ("unlicense", "unencumbered", r"this_is_free_and_unencumbered_software_released_into_the_public_domain"),
    ("zlib", "express", r"this_software_is_provided_'as_is',_without_any_express_or_implied_warranty"),
    ("public-domain", "public", r"(?:dedicated|released)_(?:in)?to_the_public_domain"),
    ("proprietary", "rights", r"all_rights_reserved"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int  # lower goes first
    score: float
    keyword: bytes
    pattern: re.Pattern[bytes]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules in order of priority: tags, links and full texts, grants, names."""
    out = []

    def add(kind: str, label: str, priority: int, score: float, keyword: str, pattern: str) -> None:
        pattern = pattern.replace("#v", r"(?:v(?:ersion|er)?\.?[\s-]*)?").replace("_?", "~").replace("_", r"[\s_-]+").replace("~", r"[\s_-]*")
        expression = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + pattern.encode() + rb")(?![0-9a-z\x80-\xff]|\.[0-9])")
        out.append(Rule(f"{kind}-{len(out)}", label, priority, score, keyword.encode(), expression))

    names = [*NAMES]
    for short, long in TERMS:
        for version in VERSIONS:
            number = re.escape(version)
            ending = r"(?:_(?:international|unported|generic))?(?:_(?:public_)?licen[sc]e)?"
            names.append((f"cc-{short}-{version}", "cc", rf"cc_{short.replace('-', '_')}_#v{number}{ending}"))
            names.append((f"cc-{short}-{version}", "creative", rf"creative_commons_{long}_#v{number}{ending}"))
    for label in dict.fromkeys(name[0] for name in names):
        add("tag", label, 0, 1.0, "spdx", rf"spdx_license_identifier:\s*{re.escape(label)}(?:_(?:only|or_later))?")
    for short, _ in TERMS:
        for version in VERSIONS:
            add("link", f"cc-{short}-{version}", 1, 0.95, "creativecommons", rf"creativecommons\.org/licenses/{short}/{re.escape(version)}")
    for label, keyword, pattern in LINKS:
        add("link", label, 1, 0.95, keyword, pattern)
    for label, keyword, pattern in TEXTS:
        add("text", label, 1, 0.9, keyword, pattern)
    for label, keyword, pattern in names:
        add("grant", label, 2, 0.95, keyword, rf"{GRANTS}_(?:for_use_)?under_(?:the_)?(?:terms_of_(?:the_)?)?(?:{pattern})")
    for label, keyword, pattern in names:
        add("name", label, 3, 0.8, keyword, pattern)
    return tuple(out)


def detections(low: bytes) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) of a lowered text that survive suppression, in order of place."""
    present: dict[bytes, bool] = {}
    found = []
    for rule in rules():
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in low
        if present[rule.keyword]:
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(low)]
    found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label, d[2].name))
    # `ends` holds, by start, the furthest end of the detections taken: containment is one bisection
    starts: list[int] = []
    ends: list[int] = []
    taken = []
    for start, end, rule in found:
        k = bisect_right(starts, start)
        if k and ends[k - 1] >= end:
            continue
        taken.append((start, end, rule))
        while k < len(starts) and ends[k] <= end:
            del starts[k], ends[k]
        starts.insert(k, start)
        ends.insert(k, end)
    return sorted(taken, key=lambda d: (d[0], d[1], d[2].name))


def scan_text(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """Number of words, base places (word index, label), and detections (byte offsets)."""
    low = text.encode().lower()  # bytes.lower() touches A-Z only
    words = WORD.findall(low)
    places = []
    if b"license" in low:
        at = -1
        for _ in range(words.count(b"license")):
            at = words.index(b"license", at + 1)
            for phrase, label in BASE:
                first = at - len(phrase) + 1
                if first >= 0 and tuple(words[first : at + 1]) == phrase:
                    places.append((first, label))
    return len(words), places, detections(low)


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, detections array<struct<label: string, rule: string, first: long, beyond: long>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row with counts, labels and the surviving detections (byte spans of the UTF-8 text).

    Row-local. A null text is empty: no words, empty labels, null places, score 0. Null doc_ids and
    repeated rows are kept; an empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
        span = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("beyond", pa.int64())]))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, places, found = scan_text(text.as_py() or "")
                at, base = [p for p, _ in places], {label for _, label in places}
                labels = base | {rule.label for _, _, rule in found}
                score = max([BASE_SCORE] * bool(base) + [rule.score for _, _, rule in found], default=0.0)
                spans = [{"label": r.label, "rule": r.name, "first": a, "beyond": b} for a, b, r in found]
                rows.append((
                    doc_id, n, len(places), min(at, default=None), max(at, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, span], strict=True)], names)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, SCANNED)
