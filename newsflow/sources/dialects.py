"""Landed feed bytes to text, and feed text to one spelling: charsets, root elements, namespace prefixes, XHTML content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import let

# Namespaces of the feed formats and the prefix under which the readers know their elements.
NAMESPACES = (
    ("http://www.w3.org/2005/Atom", "atom"),
    ("http://purl.org/rss/1.0/", "rss"),
    ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf"),
    ("http://purl.org/rss/1.0/modules/content/", "content"),
    ("http://purl.org/dc/elements/1.1/", "dc"),
    ("http://search.yahoo.com/mrss/", "media"),
    ("http://search.yahoo.com/mrss", "media"),
    ("http://www.w3.org/1999/xhtml", "xhtml"),
)
# The characters of windows-1252 for the bytes 80 to 9F and of ISO-8859-15 where it differs from ISO-8859-1.
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
LATIN_9 = {"¤": "€", "¦": "Š", "¨": "š", "´": "Ž", "¸": "ž", "¼": "Œ", "½": "œ", "¾": "Ÿ"}
WESTERN = ("iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "l1", "us-ascii", "ascii", "windows-1252", "cp1252", "x-cp1252")

_PROLOGUE = r"(?s)^[\x{FEFF}\s]*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>\s*)*"
_ROOT = _PROLOGUE + r"<(?:([^\s<>/:]+):)?([^\s<>/:]+)"
_DECLARED = r"""\sxmlns:([\p{L}_][\p{L}\p{N}_.-]*)\s*=\s*["']\s*([^"']*?)\s*["']"""
_XHTML = r"""(?s)(<(content|summary|title)\b[^>]*\btype\s*=\s*["']xhtml["'][^>]*(?<!/)>)(.*?)(</\2\s*>)"""
_HELD, _OPEN, _CLOSE = "\ue000", "\ue001", "\ue002"  # private characters that stand in for markup while it is rewritten


def decode_bytes(content: Column) -> Column:
    """Text of a landed document: by its byte order mark, else by the encoding that its XML declaration names.

    Western one-byte encodings are read as windows-1252, as browsers do, ISO-8859-15 and UTF-16 as themselves; all else as
    UTF-8, in which invalid bytes become replacement characters. NULL stays NULL.
    """
    # The first bytes as hex digits show the marks, as Latin letters the declaration.
    start = F.hex(F.substring(content, 1, 4))
    latin = F.decode(content, "ISO-8859-1")
    head = F.decode(F.substring(content, 1, 400), "ISO-8859-1")
    named = F.lower(F.regexp_extract(head, r"""^\s*<\?xml[^>]*?\sencoding\s*=\s*["']([A-Za-z0-9._-]+)""", 1))

    def utf_16(order: str, skip: int) -> Column:
        # Two bytes for each unit; a last odd one is left out.
        units = F.floor((F.octet_length(content) - skip) / 2).cast("int")
        return F.decode(F.substring(content, F.lit(skip + 1), units * 2), f"UTF-16{order}")

    high = "".join(map(chr, range(0x80, 0xA0)))
    return (
        F.when(F.startswith(start, F.lit("EFBBBF")), F.make_valid_utf8(F.substring(content, 4, 2**31 - 1).cast("string")))
        .when(F.startswith(start, F.lit("FEFF")), utf_16("BE", 2))
        .when(F.startswith(start, F.lit("FFFE")), utf_16("LE", 2))
        .when(start == "003C003F", utf_16("BE", 0))
        .when(start == "3C003F00", utf_16("LE", 0))
        .when(named.isin(*WESTERN), F.translate(latin, high, WINDOWS_1252))
        .when(named.isin("iso-8859-15", "latin-9"), F.translate(latin, "".join(LATIN_9), "".join(LATIN_9.values())))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def root_prefix(body: Column) -> Column:
    """Namespace prefix of the root element, empty without one."""
    return F.regexp_extract(body, _ROOT, 1)


def root_name(body: Column) -> Column:
    """Name of the root element without its prefix; ``{`` for a JSON object; empty for other text."""
    first = F.regexp_extract(body, r"(?s)^[\x{FEFF}\s]*(.)", 1)
    return F.when(first == "{", first).when(first == "<", F.regexp_extract(body, _ROOT, 2)).otherwise("")


def _outside_cdata(body: Column, change) -> Column:  # noqa: ANN001
    """``change`` applied to everything that does not stand in a CDATA section."""

    def part(x: Column, i: Column) -> Column:
        end = F.locate("]]>", x)
        rest = F.substring(x, end + 3, F.length(x))
        section = F.when(end > 0, F.concat(F.substring(x, F.lit(1), end + 2), change(rest))).otherwise(x)
        return F.when(i == 0, change(x)).otherwise(F.concat(F.lit("<![CDATA["), section))

    return F.array_join(F.transform(F.split(body, r"<!\[CDATA\[", -1), part), "")


def with_known_prefixes(body: Column) -> Column:
    """A feed whose elements stand under the prefixes of ``NAMESPACES``, whatever prefixes the document chose for them.

    Elements of the root's own format (Atom in an Atom feed, RSS 1.0 in an RDF one) and XHTML get none. Prefixes of other
    namespaces stay; one that has the name of a known prefix and another known namespace is told apart. A prefix has one
    meaning in a document, the first that it declares. Text in CDATA sections is left alone, and a document that needs
    no change passes as it is.
    """
    known = F.create_map(*[F.lit(x) for pair in NAMESPACES for x in pair])
    root = root_name(body)
    own = F.when(root == "RDF", "rss").when(root.isin("feed", "entry"), "atom").otherwise("")
    declared = F.struct(
        F.regexp_extract_all(body, F.lit(_DECLARED), F.lit(1)).alias("names"),
        F.regexp_extract_all(body, F.lit(_DECLARED), F.lit(2)).alias("spaces"), own.alias("own"),
    )

    def changed(d: Column) -> Column:
        def entry(name: Column, space: Column) -> Column:
            wanted = F.try_element_at(known, space)
            new = F.when((wanted == d.own) | (wanted == "xhtml"), "").otherwise(F.concat(wanted, F.lit(":")))
            return F.struct(name.alias("old"), new.alias("new"))

        pairs = F.zip_with(d.names, d.spaces, entry)
        first = F.filter(pairs, lambda p, i: p.new.isNotNull() & (F.array_position(d.names, p.old) == i + 1))
        return F.filter(first, lambda p: p.new != F.concat(p.old, F.lit(":")))

    def rename(pairs: Column) -> Column:
        numbered = F.transform(pairs, lambda p, i: F.struct(p.old, p.new, F.concat(F.lit(_HELD), i.cast("string"), F.lit(":")).alias("held")))

        def change(text: Column) -> Column:
            out = F.aggregate(
                numbered, text,
                lambda t, p: F.regexp_replace(t, F.concat(F.lit("(</?)"), F.replace(p.old, F.lit("."), F.lit(r"\.")), F.lit(":")), F.concat(F.lit("$1"), p.held)),
            )
            return F.aggregate(numbered, out, lambda t, p: F.replace(t, p.held, p.new))

        return _outside_cdata(body, change)

    renamed = let(declared, lambda d: let(changed(d), lambda c: F.when(F.size(c) > 0, rename(c)).otherwise(body)))
    return F.when(F.contains(body, F.lit("xmlns:")), renamed).otherwise(body)


def with_xhtml_as_text(body: Column) -> Column:
    """Inline XHTML of titles, summaries and contents as the markup that it is, in a CDATA section."""
    sections = F.replace(F.replace(body, F.lit("<![CDATA["), F.lit(_OPEN)), F.lit("]]>"), F.lit(_CLOSE))
    wrapped = F.regexp_replace(sections, _XHTML, r"$1<![CDATA[$3]]>$4")

    def restored(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(_OPEN), F.lit("<![CDATA[")), F.lit(_CLOSE), F.lit("]]>"))

    # A section within XHTML cannot stand inside another one; its text does.
    kept = F.translate(_outside_cdata(wrapped, restored), _OPEN + _CLOSE, "")
    return F.when(F.contains(body, F.lit("xhtml")), kept).otherwise(body)


def feed_markup(body: Column) -> Column:
    """An XML feed in the one spelling that the readers' schema names; a lone Atom entry as a feed of one."""
    known = let(with_known_prefixes(body), with_xhtml_as_text)
    alone = F.concat(F.lit("<feed>"), F.regexp_replace(known, r"(?s)^[\x{FEFF}\s]*<\?xml.*?\?>", ""), F.lit("</feed>"))
    return F.when(root_name(body) == "entry", alone).otherwise(known)
