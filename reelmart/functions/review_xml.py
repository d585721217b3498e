"""Fields of the XML review log, all taken from one parse of the document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document root, record element, and output column per field element.
ROOT = "reviewlog"
RECORD = "log"
FIELDS = {
    "logDate": "log_date",
    "device": "device",
    "os": "os",
    "location": "location",
    "ipAddress": "ip",
    "phoneNumber": "phone_number",
}

_BAD = "_malformed"

# Every element is an array, so that of repeated elements the first can be taken.
_SCHEMA = (
    f"{RECORD} array<struct<{', '.join(f'{name}: array<string>' for name in FIELDS)}>>, {_BAD} string"
)

# What may stand between the parts of a document without being one: its text is not looked at.
_REMARK = r"<!--.*?-->|<\?.*?\?>"
_DOCTYPE = r"""<!DOCTYPE(?:[^>\["']|"[^"]*"|'[^']*')*(?:\[(?:"[^"]*"|'[^']*'|<!--.*?-->|[^\]"'])*\]\s*)?>"""

# Name of the first element, past declaration, remarks and doctype.
_FIRST_ELEMENT = rf"(?s)^\s*(?:(?:{_REMARK}|{_DOCTYPE})\s*)*<([^\s/>!?]+)"

# The closing root tag with something after it, once remarks and CDATA sections are taken out.
_AFTER_ROOT = rf"</{ROOT}\s*>\s*\S"
_AFTER_EMPTY_ROOT = r"""^\s*<[^\s/>]+(?:\s(?:[^>"'/]|"[^"]*"|'[^']*')*)?/>\s*\S"""

# An entity that XML does not know by itself.
_ENTITY = r"&(?!(?:lt|gt|amp|apos|quot);)([A-Za-z_:][\w:.-]*);"

# A tag whose name differs from one of the fixed names in case only.
_NAMES = "|".join((ROOT, RECORD, *FIELDS))
_OTHER_CASE = rf"<(?!/?(?:{_NAMES})[\s/>])/?(?i:{_NAMES})[\s/>]"

# A character that no XML document can hold, not even by its number.
_BETWEEN = "\uffff"

# A document of nothing but the known elements, with text that names no entity. The pattern is linear:
# no part of it gives back what it has taken.
_ELEMENT = rf"<({'|'.join(FIELDS)})>[^<&]*+</\1>"
_SIMPLE = rf"^\s*+<{ROOT}>\s*+<{RECORD}>(?:\s*+{_ELEMENT})*+\s*+</{RECORD}>\s*+</{ROOT}>\s*+$"


def document_of(log: Column) -> Column:
    """The log text; an empty one is no document."""
    return F.nullif(log.cast("string"), F.lit(""))


def parsed_log(document: Column, fail_on_malformed: bool = False) -> Column:
    """The document as a struct, for the functions below."""
    return F.from_xml(
        document,
        _SCHEMA,
        {
            "ignoreSurroundingSpaces": "false",
            "columnNameOfCorruptRecord": _BAD,
            "mode": "FAILFAST" if fail_on_malformed else "PERMISSIVE",
        },
    )


def is_simple(document: Column) -> Column:
    """True for a document that none of the rarer forms below can apply to: the parse alone tells all."""
    return F.coalesce(document.rlike(_SIMPLE), F.lit(False))


def has_review_root(document: Column) -> Column:
    """Whether the document's outermost element is the review log."""
    return F.regexp_extract(document, _FIRST_ELEMENT, 1) == ROOT


def _body(document: Column) -> Column:
    return F.when(
        document.contains("<!DOCTYPE"), F.regexp_replace(document, rf"(?s){_DOCTYPE}", "")
    ).otherwise(document)


def _names_entity(document: Column) -> Column:
    """Whether the document has a doctype and names an entity that is not built in."""
    return document.contains("<!DOCTYPE") & _body(document).rlike(_ENTITY)


def plain_document(document: Column) -> Column:
    """The document without its doctype, of which Spark's XML parser knows nothing.

    Entities that the doctype declares become a letter. A document that names an entity it does not
    declare itself is cut off, so that it counts as malformed: nothing outside it is ever loaded.
    """
    declared = F.regexp_extract_all(document, F.lit(r"<!ENTITY\s+([A-Za-z_:][\w:.-]*)\s"), F.lit(1))
    named = F.regexp_extract_all(_body(document), F.lit(_ENTITY), F.lit(1))
    external = document.rlike(r"(?s)<!DOCTYPE\s+\S+\s+(?:SYSTEM|PUBLIC)\s")
    resolved = (F.size(F.array_except(named, declared)) == 0) & ~external
    replaced = F.regexp_replace(_body(document), _ENTITY, "x")
    return F.when(
        _names_entity(document), F.when(resolved, replaced).otherwise("<cut")
    ).otherwise(_body(document))


def needs_xpath(document: Column) -> Column:
    """Whether only the slow route reads the document as XPath does.

    The XML parser ignores the case of names and declares no entities; both are rare.
    """
    return document.rlike(_OTHER_CASE) | _names_entity(document)


def is_unreadable(parsed: Column) -> Column:
    """Whether the parser gave up; NULL without a document."""
    return parsed[_BAD].isNotNull()


def is_malformed(document: Column, parsed: Column) -> Column:
    """True for a document that cannot be read as XML, NULL without a document."""
    # The parser stops at the end of the root element, so what follows is looked at here.
    marked = document.contains("<!") | document.contains("<?")
    told = F.regexp_replace(document, rf"(?s){_REMARK}|<!\[CDATA\[.*?\]\]>|{_DOCTYPE}", "")
    told = F.when(marked, told).otherwise(document)
    return is_unreadable(parsed) | told.rlike(_AFTER_ROOT) | told.rlike(_AFTER_EMPTY_ROOT)


def texts_by_xpath(document: Column) -> Column:
    """The text of each field element in their order, by the slow route; the document must be sound.

    One look at the document tells them all: XPath takes of each the text that it would take alone.
    """
    source = F.when(_names_entity(document), document).otherwise(_body(document))
    paths = f", '{_BETWEEN}', ".join(f"/{ROOT}/{RECORD}/{name}" for name in FIELDS)
    return F.split(F.xpath_string(source, F.lit(f"concat({paths})")), _BETWEEN, -1)


def first_text(parsed: Column, name: str) -> Column:
    """Text of the first ``name`` element below the records, inner markup included."""
    records = parsed[RECORD]
    return F.coalesce(
        F.get(F.get(records, F.lit(0))[name], F.lit(0)),
        # the first record lacks the element: look through the others
        F.get(F.flatten(F.filter(records[name], lambda texts: texts.isNotNull())), F.lit(0)),
    )


def has_markup(text: Column) -> Column:
    """Whether a text may differ from what XPath gives, by markup inside the element; such a one is rare."""
    return F.coalesce(text.contains("<"), F.lit(False))
