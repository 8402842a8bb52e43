"""Command line: ``python -m arbordf STYLESHEET DOCUMENT OUTPUT [html]`` transforms one document."""

import sys
from pathlib import Path

from .plans.stylesheet import Stylesheet


def main(args: list[str]) -> int:
    if len(args) not in (3, 4):
        print(__doc__, file=sys.stderr)
        return 2
    sheet, document, output = args[:3]
    result = Stylesheet.from_file(sheet).render(Path(document).read_text(encoding="utf-8"), kind=args[3] if len(args) == 4 else "xml")
    Path(output).write_text(result + "\n", encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
