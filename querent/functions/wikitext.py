"""A scanner for wiki markup: what a reader sees of a text, and its sections.

One pass keeps a stack of what is open: templates, tables and links, in the order in which they were opened. A
closing mark closes the innermost open one of its kind, and what was opened inside and not closed goes with it or
stays as text. Nothing that is never closed hides what follows, but for a template after which no brace closes at all.
"""

from __future__ import annotations

#: Namespaces whose links show nothing; headings that open a plot, best first; words of headings that don't.
HIDDEN_LINKS = ("file:", "image:")
PLOT_HEADINGS = ("plot", "plot summary", "synopsis", "premise", "story", "storyline", "overview", "series overview", "summary", "plots")
_MARKS = "{}[]|"


class _Scan:
    """What is written so far, and what is open: its mark, the piece where it began, and how many single braces and
    brackets stood before it. One that stands inside spoils a template or link, which then stays as text."""

    def __init__(self):
        self.out: list[str] = []
        self.stack: list[tuple[str, int, int, int]] = []
        self.open = {"{{": 0, "{|": 0, "[[": 0}
        self.braces = self.brackets = 0

    def push(self, mark: str, shown: str) -> None:
        self.stack.append((mark, len(self.out), self.braces, self.brackets))
        self.open[mark] += 1
        self.out.append(shown)

    def pop(self, mark: str) -> tuple[int, bool]:
        """Where the innermost one of a kind began, and whether it is spoilt; those opened inside it are closed with it."""
        while True:
            kind, at, braces, brackets = self.stack.pop()
            self.open[kind] -= 1
            if kind == mark:
                return at, (self.brackets > brackets if mark == "[[" else self.braces > braces)

    def remove(self, at: int, brackets: int | None = None) -> None:
        del self.out[at:]
        if brackets is not None:  # a bracket that has gone spoils nothing
            self.brackets = brackets


def _without_comments(text: str) -> str:
    """Comments go, and references with what they hold; one that isn't closed stays for the tags."""
    if "<" not in text:
        return text
    low = text.lower()
    low = low if len(low) == len(text) else text
    out, at = [], 0
    while (found := text.find("<", at)) >= 0:
        end = found + 1
        if text.startswith("<!--", found):
            close = text.find("-->", found + 4)
            end = close + 3 if close >= 0 else end
        elif low.startswith("<ref", found) and not (text[found + 4 : found + 5].isalnum() or text[found + 4 : found + 5] == "_"):
            close = text.find(">", found)
            if close > 0 and text[close - 1] == "/":
                end = close + 1
            elif close > 0:
                last = low.find("</ref>", close)
                end = last + 6 if last >= 0 else end
        out.append(text[at:found])
        if end == found + 1:
            out.append("<")
        at = end
    return "".join([*out, text[at:]])


def _label(pieces: list[str], spoilt: bool) -> str:
    """What a link shows: what follows its first bar, or all of it."""
    whole = "".join(pieces)
    if spoilt or not whole:
        return f" {whole} "
    label = whole.partition("|")[2]
    return label or whole


def _outside(text: str) -> str:
    """The text without templates and tables, links by their labels."""
    scan, at, n = _Scan(), 0, len(text)
    out = scan.out
    while at < n:
        start = at
        while at < n and text[at] not in _MARKS:
            at += 1
        if at > start:
            out.append(text[start:at])
        two = text[at : at + 2]
        if two == "{{":
            width = len(text[at:]) - len(text[at:].lstrip("{")) if text[at + 2 : at + 3] == "{" else 2
            if width % 2:
                out.append("{")
            for _ in range(width // 2):
                scan.push("{{", " ")
            at += width
        elif two in ("{|", "[["):
            scan.push(two, "{|" if two == "{|" else " ")
            at += 2
        elif two == "}}":
            at += 2
            if scan.open["{{"]:
                brackets = next(o[3] for o in reversed(scan.stack) if o[0] == "{{")
                begin, spoilt = scan.pop("{{")
                if spoilt:
                    out.append(" ")
                else:
                    scan.remove(begin, brackets)
            else:
                out.append(" ")
        elif two == "|}" and text[at + 2 : at + 3] != "}" and scan.open["{|"]:
            at += 2
            scan.remove(scan.pop("{|")[0])
        elif two == "]]":
            at += 2
            hidden = next((o for o in scan.stack if o[0] == "[[" and _hides(scan, o)), None) if scan.open["[["] else None
            if hidden is not None:
                while scan.stack and scan.stack[-1][1] >= hidden[1]:
                    scan.open[scan.stack.pop()[0]] -= 1
                scan.remove(hidden[1])
            elif scan.stack and scan.stack[-1][0] == "[[":
                begin, spoilt = scan.pop("[[")
                out[begin:] = [_label(out[begin + 1 :], spoilt)]
            else:
                out.append(" ")
        elif at < n:
            scan.braces += text[at] in "{}"
            scan.brackets += text[at] == "]"
            out.append(text[at])
            at += 1
    last = max((k for k, piece in enumerate(out) if "}" in piece), default=-1)
    endless = next((at for mark, at, _, _ in scan.stack if mark == "{{" and at > last), None)
    return "".join(out if endless is None else out[:endless])


def _hides(scan: _Scan, link: tuple[str, int, int, int]) -> bool:
    _, at, _, brackets = link
    return scan.brackets == brackets and len(scan.out) > at + 1 and scan.out[at + 1].lower().startswith(HIDDEN_LINKS)


def _without_tags(text: str) -> str:
    """Tags go alone; a sign that no other closes stays."""
    out, at = [], 0
    while (found := text.find("<", at)) >= 0:
        close = text.find(">", found + 2)
        if close < 0:
            break
        out.append(text[at:found])
        at = close + 1
    return "".join([*out, text[at:]])


def _labelled(text: str) -> str:
    """[address label] as its label; one without a label stays."""
    out, at = [], 0
    while (found := text.find("[http", at)) >= 0:
        close = text.find("]", found)
        address, _, label = " ".join(text[found + 1 : close].split(None, 1)).partition(" ")
        out.append(text[at:found])
        if close > 0 and label and address.startswith(("http://", "https://")):
            out.append(label)
        else:
            close = found
            out.append("[")
        at = close + 1
    return "".join([*out, text[at:]])


def _unquoted(text: str) -> str:
    """Runs of two or more quote marks are bold or italic; a single one is an apostrophe."""
    out, at = [], 0
    while (found := text.find("''", at)) >= 0:
        out.append(text[at:found])
        at = found
        while text[at : at + 1] == "'":
            at += 1
    return "".join([*out, text[at:]])


def _tidy(text: str) -> str:
    """No blanks at a line's end, one blank for several, one empty line for several, nothing empty around."""
    lines: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip(" \t")
        if "\t" in line or "  " in line:
            line = _one_blank(line)
        if line or not lines or lines[-1]:
            lines.append(line)
    return "\n".join(lines).strip()


def _one_blank(line: str) -> str:
    out, run = [], ""
    for char in line:
        if char in " \t":
            run += char
        else:
            out += [run if len(run) < 2 else " ", char]
            run = ""
    return "".join(out)


def _headless(text: str) -> str:
    """Without a heading that the text begins with."""
    body = text.lstrip()
    signs = len(body) - len(body.lstrip("="))
    if signs < 2 or body[signs : signs + 1] in ("", "\n"):
        return text
    close = body.find("==", signs + 1)
    if close < 0 or "\n" in body[signs + 1 : close]:
        return text
    return body[close:].lstrip("=").lstrip()


def plain(markup: str | None) -> str:
    """The text that a reader sees."""
    return _tidy(_unquoted(_without_tags(_labelled(_outside(_without_comments(_headless(markup or "")))))))


def sections(markup: str) -> list[tuple[str, str]]:
    """Name and body of each section of the second level, in order; its own subsections belong to the body."""
    found: list[tuple[str, list[str]]] = []
    for line in markup.split("\n"):
        inner = line.rstrip(" \t")[2:-2]
        name = inner.strip(" \t")
        if line.startswith("==") and line.rstrip(" \t").endswith("==") and name and "=" not in inner:
            found.append((_without_tags(name).strip(" "), []))
        elif found:
            found[-1][1].append(line)
    return [(name, "\n".join(body)) for name, body in found]


def plot(markup: str | None) -> tuple[str, str] | None:
    """Name and plain text of the first section whose heading has the name of a plot and whose text isn't empty."""
    for name, body in sections(markup or ""):
        if any(heading in name.lower() for heading in PLOT_HEADINGS):
            text = plain(body)
            if text:
                return name, text
    return None
