"""LaTeX of labels and table cells as MathML: letters, numbers, indices, fractions, roots, accents and words. What it doesn't know is an error."""

from __future__ import annotations

import html
import re

_PIECE = re.compile(r"\\([A-Za-z]+)|\\([^A-Za-z])|(\d+(?:[.,]\d+)*)|([A-Za-zµ])|([{}^_'])|(\s+)|(.)", re.DOTALL)
#: Accents over what follows, and commands that have a character of their own.
ACCENTS = {"dot": "˙", "ddot": "¨", "bar": "¯", "overline": "¯", "hat": "^", "tilde": "~", "vec": "→"}
SIGNS = {"cdot": "·", "infty": "∞", "sum": "∑", "int": "∫", "partial": "∂", "epsilon": "ε", "eta": "η", "kappa": "κ", "tau": "τ", "omega": "ω", "Omega": "Ω", "pi": "π", "to": "→", "quad": " ", "left": "", "right": ""}
WORDS = {"mathrm", "text", "textrm", "operatorname", "mathbf", "mathit"}


class _Formula:
    def __init__(self, latex: str, signs: dict[str, str]) -> None:
        self.pieces = [m for m in _PIECE.finditer(latex)]
        self.at, self.signs = 0, signs

    def next(self) -> re.Match | None:
        return self.pieces[self.at] if self.at < len(self.pieces) else None

    def row(self, closing: bool) -> str:
        """Everything up to the closing brace, or to the end."""
        parts: list[str] = []
        while (m := self.next()) is not None and m[5] != "}":
            if m[6]:
                self.at += 1
            else:
                parts.append(self.scripted())
        if closing != (m is not None):
            raise ValueError("braces that don't match")
        self.at += closing
        return parts[0] if len(parts) == 1 else f"<mrow>{''.join(parts)}</mrow>"

    def scripted(self) -> str:
        """One atom with what stands below and above it."""
        first = self.next()
        base = "<mrow></mrow>" if first is not None and first[5] in ("^", "_", "'") else self.atom()
        below = above = None
        while (m := self.next()) is not None and m[5] in ("^", "_", "'"):
            self.at += 1
            if m[5] == "'":
                above = (above or "") + "<mo>′</mo>"
            elif m[5] == "_":
                below = self.one_script(below)
            else:
                above = (above or "") + self.one_script(None)
        if above is not None and above.count("<mo>") > 1:
            above = f"<mrow>{above}</mrow>"
        if below is not None and above is not None:
            return f"<msubsup>{base}{below}{above}</msubsup>"
        if below is not None:
            return f"<msub>{base}{below}</msub>"
        return base if above is None else f"<msup>{base}{above}</msup>"

    def one_script(self, known: str | None) -> str:
        if known is not None:
            raise ValueError("two subscripts of one base")
        return self.atom()

    def atom(self) -> str:
        m = self.next()
        if m is None:
            raise ValueError("something is missing at the end")
        self.at += 1
        command, escaped, number, letter, mark, space, other = m.groups()
        if space:
            return self.atom()
        if number:
            return f"<mn>{number}</mn>"
        if letter:
            return f"<mi>{letter}</mi>"
        if mark == "{":
            return self.row(closing=True)
        if mark:
            raise ValueError(f"{mark} out of place")
        if command is None:
            return f"<mo>{html.escape(escaped or other)}</mo>"
        if command == "frac":
            return f"<mfrac>{self.atom()}{self.atom()}</mfrac>"
        if command == "sqrt":
            return f"<msqrt>{self.atom()}</msqrt>"
        if command in ACCENTS:
            return f"<mover>{self.atom()}<mo>{ACCENTS[command]}</mo></mover>"
        if command in WORDS:
            return f"<mtext>{html.escape(self.words())}</mtext>"
        sign = self.signs.get(command, SIGNS.get(command))
        if sign is None:
            raise ValueError(f"unknown: \\{command}")
        return f"<mi>{sign}</mi>" if sign.isalpha() else f"<mo>{sign}</mo>"

    def words(self) -> str:
        """The text in the braces that follow, as it stands."""
        if (m := self.next()) is None or m[5] != "{":
            raise ValueError("a brace expected")
        self.at += 1
        text = ""
        while (m := self.next()) is not None and m[5] != "}":
            text += m[0]
            self.at += 1
        if m is None:
            raise ValueError("braces that don't match")
        self.at += 1
        return text


def mathml(latex: str) -> str:
    """MathML of an inline formula; ValueError for what isn't understood."""
    from sedimark.functions.markup import SYMBOLS

    return f'<math display="inline">{_Formula(latex, SYMBOLS).row(closing=False)}</math>'
