"""XML read as a stream: memory doesn't follow the document, and document types and entities are refused in any encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

#: Bytes given to the parser at a time.
BLOCK = 2**16


def _refuse(*_) -> None:
    raise ValueError("XML invalido: DOCTYPE o entidades no permitidas")


def feed(stream, start: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None]) -> Iterator[None]:
    """Call the handlers while the stream is read; control comes back after each block. Names are `namespace}local`."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = _refuse
    try:
        while block := stream.read(BLOCK):
            parser.Parse(block)
            yield
        parser.Parse(b"", True)
        yield
    except expat.ExpatError as e:
        raise ValueError(f"XML invalido: {e}") from e
