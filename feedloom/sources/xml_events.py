"""Feed documents as elements in document order, with line numbers and the first error.

One Arrow step reads a document with the standard library's XML parser and gives an event for
every element at its end: tag (lower case), the tag around it, the attributes that feeds use, its
text and its line. Events inside an item or entry stand in that item's array; the others are the
feed's own, those before the first item in one array and those after it in another. What the
events mean is left to column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

EVENT = "struct<tag:string,around:string,text:string,url:string,type:string,rel:string,href:string,line:int>"
DOCUMENT = (f"struct<is_atom:boolean,head:array<{EVENT}>,tail:array<{EVENT}>,items:array<array<{EVENT}>>,"
            "error:struct<line:int,message:string>>")
_ITEM = ("item", "entry")
_ATTRIBUTES = ("url", "type", "rel", "href")
PIECE_CHARS = 1 << 20


def read_document(xml: str) -> dict:
    """The events of one document. An error ends it; what was read up to there stays.

    Text is what follows the last tag inside the element, without white space around it. A
    document with an item inside another goes on with the inner one, as a plain reader would.
    """
    from xml.parsers import expat

    head: list[dict] = []
    tail: list[dict] = []
    items: list[list[dict]] = []
    open_: list[tuple[str, dict]] = []
    state = {"atom": False, "item": None, "text": []}

    def start(tag: str, attributes: dict) -> None:
        tag = tag.lower()
        state["text"] = []
        state["atom"] |= tag == "feed"
        open_.append((tag, {"line": parser.CurrentLineNumber, **{k: attributes.get(k) for k in _ATTRIBUTES}}))
        if tag in _ITEM:
            state["item"] = []
            items.append(state["item"])

    def end(_: str) -> None:
        tag, event = open_.pop()
        event |= {"tag": tag, "around": open_[-1][0] if open_ else None, "text": "".join(state["text"]).strip()}
        state["text"] = []
        if tag in _ITEM:
            state["item"] = None
        elif state["item"] is not None:
            state["item"].append(event)
        else:
            (tail if items else head).append(event)

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: state["text"].append(data)
    error = None
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError as e:
        error = {"line": e.lineno, "message": expat.errors.messages[e.code]}
    return {"is_atom": state["atom"], "head": head, "tail": tail, "items": items, "error": error}


def event_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts to ``DOCUMENT`` values, which leave in pieces of about ``PIECE_CHARS`` of input, so
    that a worker holds the events of a few documents at a time, however many a batch brings."""
    fields = [(n, pa.int32() if n == "line" else pa.string()) for n in ("tag", "around", "text", *_ATTRIBUTES, "line")]
    events = pa.list_(pa.struct(fields))
    kind = pa.struct([("is_atom", pa.bool_()), ("head", events), ("tail", events), ("items", pa.list_(events)),
                      ("error", pa.struct([("line", pa.int32()), ("message", pa.string())]))])
    for texts in batches:
        piece, chars = [], 0
        for text in texts:
            xml = text.as_py()
            piece.append(None if xml is None else read_document(xml))
            chars += len(xml or "")
            if chars >= PIECE_CHARS:
                yield pa.array(piece, kind)
                piece, chars = [], 0
        yield pa.array(piece, kind)


def feed_document(xml):
    """Column function: text to ``DOCUMENT``; null stays null."""
    @F.arrow_udf(DOCUMENT)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return event_arrays(batches)

    # Said to be nondeterministic, so that no rule of the planner has it run once more for a filter.
    return read.asNondeterministic()(xml)
