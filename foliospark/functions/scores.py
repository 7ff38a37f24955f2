"""Scores, extractors and cleaners (portable expressions)."""

from __future__ import annotations

from foliospark.functions.portable import Dialect, cases


def token_estimate(d: Dialect, t: str) -> str:
    return f"cast({d.div(f'length({t})', '4')} as bigint)"


def cache_key(d: Dialect, t: str, lang: str, model: str) -> str:
    """sha256 of the text, then language and model in clear."""
    return f"concat({d.sha256(t)}, '_', {lang}, '_', '{model}')"


def context_key(d: Dialect, t: str, lang: str, context: str) -> str:
    return f"md5(concat({t}, '|', {lang}, '|', coalesce({context}, '')))"


def similarity_key(d: Dialect, t: str) -> str:
    """md5 of the lower-cased text with white space collapsed."""
    return f"md5({d.replace(f'lower({d.strip(t)})', chr(92) + 's+', ' ')})"


def block_id(d: Dialect, kind: str, page: str, t: str) -> str:
    return f"concat({kind}, '_', cast({page} as {'string' if d.spark else 'varchar'}), '_', {'left' if d.spark else 'left'}(md5({t}), 8))"


def sentences(d: Dialect, t: str) -> str:
    """Non-empty sentences, cut after . ! ? and white space, by a marker that no text holds."""
    marked = f"regexp_replace({t}, r'([.!?])\\s+', '$1\x01')" if d.spark else f"regexp_replace({t}, '([.!?])\\s+', '\\1\x01', 'g')"
    return d.keep(d.split(marked, "\x01"), "x <> ''")


def coherence(d: Dialect, t: str, kind: str, number: str) -> str:
    """0.5 adjusted by sentences, length, type, end mark and line breaks, within 0 and 1; in hundredths to stay exact."""
    parts = (
        cases((f"{number} = 1", "20"), (f"{number} <= 3", "10"), otherwise="0"), cases((f"length({t}) between 100 and 2000", "10"), (f"length({t}) > 5000", "-10"), otherwise="0"),
        cases((f"{kind} in ('h1', 'h2', 'h3')", "20"), (f"{kind} = 'list_item'", "10"), (f"{kind} = 'equation'", "15"), otherwise="0"), cases((d.like(t, r"[.!?]\s*$"), "5"), otherwise="0"),
        cases((f"length({t}) > 0 and 10 * {d.count(t, chr(92) + 'n')} > length({t})", "-5"), otherwise="0"),
    )
    return f"{d.double(f'greatest(0, least(100, 50 + {" + ".join(parts)}))')} / 100"


def metadata(d: Dialect, t: str) -> dict[str, str]:
    return {
        "total_length": f"cast(length({t}) as bigint)", "word_count": d.words(t), "line_count": f"{d.count(t, chr(92) + 'n')} + 1",
        "has_math": d.like(t, r"\$|\\begin\{"), "has_tables": d.has(t, "|"), "has_figures": d.has(f"lower({t})", "figure"),
    }


def markup_complexity(d: Dialect, t: str) -> str:
    """Weighted counts of math, tables and figures, at most 1."""
    return f"least({d.double(f'{d.count(t, chr(92) + "$[^$]+" + chr(92) + "$")} * 10 + {d.count(t, "[|]")} * 2 + {d.count(f"lower({t})", "figure")} * 5')} / 100, cast(1 as double))"


def strip_control(d: Dialect, t: str) -> str:
    return d.replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def safe_filename(d: Dialect, t: str) -> str:
    """Reserved characters to _, runs collapsed, edges trimmed, 100 characters at most."""
    clean = d.replace(d.replace(t, r'[<>:"/\\|?*\s]', "_"), r"_+", "_")
    return f"left({d.replace(clean, r'^[ ._-]+|[ ._-]+$', '')}, 100)"


def clean_markup(d: Dialect, t: str) -> str:
    """Drop page markers and LaTeX commands, collapse spaces."""
    out = d.replace(t, r"\[MISSING_PAGE[^\]]*\]", "")
    out = d.replace(out, r"\\[a-zA-Z]+\{?", " ")
    return d.strip(d.replace(out, r"[ \t]+", " "))


def anchor(d: Dialect, t: str) -> str:
    """A slug of letters, digits and hyphens."""
    return d.replace(d.replace(f"lower({t})", r"[^\p{L}\p{N}_\s-]", ""), r"[\s-]+", "-")


def html_block(d: Dialect, kind: str, t: str) -> str:
    """The block as an element; headings get an anchor."""
    esc = f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    heading = f"concat('<', {kind}, ' id=\"', {anchor(d, t)}, '\">', {esc}, '</', {kind}, '>')"
    return cases((f"{kind} in ('h1', 'h2', 'h3')", heading), (f"{kind} = 'list_item'", f"concat('<li>', {esc}, '</li>')"), (f"{kind} = 'code_block'", f"concat('<pre>', {esc}, '</pre>')"), otherwise=f"concat('<p>', {esc}, '</p>')")


def footnote_reference(d: Dialect, t: str) -> str:
    """First of four marks: [n], (n), superscript, ^n."""
    return "coalesce(" + ", ".join(f"nullif({d.extract(t, p)}, '')" for p in (r"\[(\d+)\]", r"\((\d+)\)", r"([¹²³⁴⁵⁶⁷⁸⁹⁰]+)", r"\^(\d+)")) + ", '')"


def toc_title(d: Dialect, t: str) -> str:
    """Title of a contents line without leaders and page."""
    return d.strip(d.replace(d.replace(t, r"^\s*\d+(\.\d+)*\.?\s+", ""), r"[ .]*\d*\s*$", ""))


def toc_page(d: Dialect, t: str) -> str:
    return d.to_int(f"nullif({d.extract(t, chr(92) + 's(' + chr(92) + 'd{1,4})' + chr(92) + 's*$')}, '')")


def ocr_quality(d: Dialect, t: str) -> str:
    """0.3 confidence by letters, 0.25 layout by line length, 0.3 completeness by words, 0.15 by clean characters; in hundredths."""
    n = f"greatest(length({t}), 1)"
    parts = (cases((f"{d.letters(t)} * 2 > {n}", "30"), otherwise="10"), cases((f"{d.count(t, chr(92) + 'n')} * 10 < {n}", "25"), otherwise="5"), cases((f"{d.words(t)} > 20", "30"), (f"{d.words(t)} > 5", "15"), otherwise="0"), cases((d.like(t, "[�□■]"), "0"), otherwise="15"))
    return f"{d.double(' + '.join(parts))} / 100"


def structure_counts(d: Dialect, t: str) -> dict[str, str]:
    """Counts that a translation must keep."""
    return {"headers": d.count(t, r"(?m)^#{1,6}\s"), "items": d.count(t, r"(?m)^\s*(?:[-*+]|\d+\.)\s"), "breaks": d.count(t, r"\n\n"), "pipes": d.count(t, "[|]"), "fences": d.count(t, "```"), "formulas": d.count(t, r"\$[^$]+\$")}


def markdown_kept(d: Dialect, a: str, b: str) -> str:
    """Two of three hold: headers at 70 %, list items at 50 %, breaks within half (ten at least)."""
    x, y = structure_counts(d, a), structure_counts(d, b)
    tests = (f"10 * {y['headers']} >= 7 * {x['headers']}", f"2 * {y['items']} >= {x['items']}", f"abs({y['breaks']} - {x['breaks']}) <= greatest(10, {x['breaks']} * 0.5)")
    return "((" + " + ".join(cases((t, "1"), otherwise="0") for t in tests) + ") >= 2)"
