"""Names of files within what is read."""

from __future__ import annotations

import re
from urllib.parse import unquote


def relative(root: str, path: str, quoted: bool = False) -> str:
    """The path below the folder or pattern that is read; the base name where a single file is.

    Rows of equally named files in different folders thus keep different identities. quoted: as in `_metadata.file_path`.
    """
    root, path = re.sub(r"^\w+:/*(?=/)", "", str(root)).rstrip("/"), re.sub(r"^\w+:/*(?=/)", "", unquote(path) if quoted else path)
    fixed = root if not re.search(r"[*?\[{]", root) else re.split(r"[*?\[{]", root, maxsplit=1)[0].rpartition("/")[0]
    at = path.find(fixed + "/") if fixed else -1
    return path[at + len(fixed) + 1 :] if at >= 0 else path.rpartition("/")[2]
