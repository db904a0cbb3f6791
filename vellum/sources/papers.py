"""Papers derived from the documents table: sections, citations and reference lists by rules on doc_id.

The text is one SQL expression that Spark and DuckDB read alike, so that both sides of a comparison have
the same papers. Every character of a document is in its paper. ``doc_id % 5`` chooses the citation style, ``% 7 = 0`` leaves the references out,
``% 11 = 0`` cites a number that isn't listed, ``% 13 = 0`` lists an entry twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: authors (surname, first name), year, title, journal
ENTRIES = [
    ((("Smith", "John"),), 2019, "Rivers of the north", "Journal of Water"),
    ((("Jones", "Kate"), ("Garcia", "Maria")), 2020, "Maps and their makers", "Atlas Review"),
    ((("Garcia", "Maria"), ("Lee", "Bo"), ("Kim", "Ann")), 2018, "Counting birds", "Field Notes"),
    ((("Chen", "Wei"),), 2021, "Sorting at scale", "Computing Letters"),
    ((("Brown", "Alan"), ("Diaz", "Eva"), ("Evans", "Fay"), ("Ford", "Gil"), ("Gray", "Hal"), ("Hill", "Ida"), ("Irwin", "Jan")), 2017, "On small harbours", "Coast Quarterly"),
    ((("Novak", "Petra"), ("Okoro", "Sam")), 2022, "Paper and ink", "Print History"),
]
CITED = {
    0: ("(Smith, 2019)", "(Jones & Garcia, 2018)", "(Okafor, 2016)"),
    1: ("(Smith 2019)", "(Chen 2021)", "(Okafor 2016)"),
    2: ("(Smith 12)", "(Brown 7)", "(Okafor 99)"),
    3: ("[1]", "[2, 3]", "[9]"),
    4: ("^1", "^2", "^7"),
}


def _entry(i: int, style: int) -> str:
    """An entry as a list of the style has it: APA, Harvard, MLA, IEEE, Chicago."""
    people, year, title, journal = ENTRIES[i]
    pages, volume, issue = f"{10 * i + 1}-{10 * i + 9}", i + 3, i + 1
    if style == 0:
        names = [f"{last}, {first[0]}." for last, first in people]
        return f"{names[0] if len(names) == 1 else ', '.join(names[:-1]) + ', & ' + names[-1]} ({year}). {title}. {journal}, {volume}({issue}), {pages}." + (" https://doi.org/10.1/x" if i == 1 else "")
    if style == 1:
        return f"{people[0][0]} ({year}) '{title}', {journal}, vol. {volume}, no. {issue}, pp. {pages}."
    if style == 2:
        return f'{people[0][0]}, {people[0][1]}. "{title}". {journal}, vol. {volume}, no. {issue} ({year}): {pages}.'
    if style == 3:
        return ", ".join(f"{first[0]}. {last}" for last, first in people) + f', "{title}," {journal}, vol. {volume}, no. {issue}, pp. {pages}, {year}.'
    return f"{people[0][0]}, {people[0][1]}. {title}. Boston: {journal} Press, {year}."


def _choice(k: int) -> str:
    return "CASE doc_id % 5 " + " ".join(f"WHEN {style} THEN '{c[k]}'" for style, c in CITED.items()) + " END"


def _reference(i: int) -> str:
    each = [(f"[{i + 1}] " if style == 3 else "") + _entry(i, style) for style in range(5)]
    return "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(each)) + " END"


def _references() -> str:
    lines = [_reference(i) for i in range(3)]
    lines += [f"CASE WHEN doc_id % 4 >= {n} THEN {_reference(2 + n)} END" for n in (1, 2, 3)]
    lines.append(f"CASE WHEN doc_id % 13 = 0 THEN {_reference(0)} END")
    lines.insert(1, "CASE WHEN doc_id % 3 = 0 THEN '    with a second line of the first entry' END")
    return ", ".join(lines)


def _share(start: int, end: int) -> str:
    """The text between two percentages of its length, with its line breaks; the shares deal out the whole text."""
    at = lambda p: f"CAST(floor(length(text) * {p} / 100) AS INT)"
    return f"substr(text, {at(start)} + 1, {at(end)} - {at(start)})"


#: The document's whole text is dealt to the sections; where a heading is left out, its part goes on under the one before.
TEXT = f"""concat_ws(chr(10), concat('# Study ', CAST(doc_id AS STRING), ' of ', lang), '', 'Abstract', {_share(0, 10)}, '', '1 Introduction',
concat({_share(10, 20)}, ' as ', {_choice(0)}, ' said.'), concat('It was shown ', {_choice(1)}, ' that we don''t know.'), '',
CASE WHEN doc_id % 2 = 0 THEN '2 Methodology' END, concat({_share(20, 45)}, CASE WHEN doc_id % 11 = 0 THEN concat(' See ', {_choice(2)}, '.') ELSE '' END), '',
'## Results', {_share(45, 70)}, '', CASE WHEN doc_id % 3 <> 1 THEN 'Discussion' END, concat('Moreover, in order to see, your going  on .', {_share(70, 90)}), '',
'CONCLUSION', concat('In conclusion, ', {_share(90, 100)}), CASE WHEN doc_id % 7 <> 0 THEN concat_ws(chr(10), '', CASE WHEN doc_id % 2 = 0 THEN 'References' ELSE 'VI. BIBLIOGRAPHY' END, {_references()}) END)"""


def load_papers(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, source, text."""
    return spark.read.parquet(f"{folder}/documents.parquet").filter("trim(text) <> ''").selectExpr("doc_id", "lang", "source", f"{TEXT} AS text")


SQL = f"(SELECT doc_id, lang, source, {TEXT} AS text FROM documents WHERE trim(text) <> '')"
