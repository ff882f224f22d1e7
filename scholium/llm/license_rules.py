"""Signature rules of the licence scan, in order.

Signatures are regular expressions over words in lower case; a blank stands for any gap between words. They are
written by hand per licence, and per form in which a licence is named: tag, field, notice, address, sentence, name.
Levels order the forms: 0 tag, 1 field, notice, address or sentence, 2 name, 3 a mere hint.
"""

from __future__ import annotations

from dataclasses import dataclass

LICENCE = "licen[cs]e"
TAG, SPOKEN, NAME, HINT = 0, 1, 2, 3
#: How sure a detection of each level is.
SURE = {TAG: 1.0, SPOKEN: 0.9, NAME: 0.7, HINT: 0.3}


@dataclass(frozen=True)
class Rule:
    """``keywords`` are parts of single words of every match; only texts that hold all of them are searched. "cc-by" stands for the words cc and by in a row."""

    label: str
    level: int
    keywords: tuple[str, ...]
    signature: str
    base: bool = False

    @property
    def pattern(self) -> str:
        """The signature over text in which every word has a blank on either side."""
        return " " + self.signature.replace(" ", "  ") + " "


def version(major: int, minor: int = 0) -> str:
    tail = "(?: 0)?" if minor == 0 else f" {minor}"
    return rf"(?:version |ver |v )?v?{major}{tail}"


LATER = r"(?: only)?(?: of the licen[cs]e)?(?: or(?: at your option)?(?: any)? (?:later|newer)(?: version)?)?"

#: label, keywords, name, tag (None: no tag), address (None: none), distinct sentences.
LICENCES: list[tuple[str, str, str, str | None, str | None, tuple[str, ...]]] = [
    ("mit", "licen mit", rf"(?:the )?mit(?: x11)?(?: style)? {LICENCE}", "mit", r"opensource org licenses mit(?: license)?(?: php| html)?",
     ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
      "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software")),
    ("mit-0", "licen mit", rf"mit (?:no attribution|0) {LICENCE}", "mit 0", None, ()),
    ("x11", "licen x11", rf"(?:the )?x11(?: mit)? {LICENCE}", "x11", None, ()),
    ("isc", "licen isc", rf"(?:the )?isc {LICENCE}", "isc", r"opensource org licenses isc(?: license)?(?: php| html)?",
     ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("apache-1.1", "licen apache", rf"apache(?: software)? {LICENCE} {version(1, 1)}", "apache 1 1", r"apache org licenses license 1 1", ()),
    ("apache-2.0", "apache", rf"apache(?: software| public)? (?:{LICENCE} )?(?:{version(2)})", "apache 2 0", r"apache org licenses license 2 0(?: txt| html)?",
     ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis")),
    ("apache", "apache", rf"(?:the )?apache(?: software| public)? {LICENCE}", None, r"apache org licenses?", ()),
    ("bsd-2-clause", "bsd", rf"(?:simplified|2 clause|two clause) bsd(?: style)? {LICENCE}|freebsd {LICENCE}|bsd (?:2|two) clause(?: {LICENCE})?", "bsd 2 clause", r"opensource org licenses bsd(?: 2 clause| license)(?: php| html)?",
     ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",)),
    ("bsd-3-clause", "bsd", rf"(?:new|modified|revised|3 clause|three clause) bsd(?: style)? {LICENCE}|bsd (?:3|three) clause(?: {LICENCE})?", "bsd 3 clause", r"opensource org licenses bsd 3 clause(?: php| html)?",
     ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
    ("bsd-4-clause", "bsd", rf"(?:original|old|4 clause|four clause) bsd {LICENCE}|bsd (?:4|four) clause(?: {LICENCE})?", "bsd 4 clause", None,
     ("all advertising materials mentioning features or use of this software must display the following acknowledgement",)),
    ("0bsd", "bsd", rf"(?:zero clause|0 clause|free public) bsd(?: {LICENCE})?|bsd zero clause {LICENCE}", "0bsd", None, ()),
    ("bsd", "licen bsd", rf"(?:the )?bsd(?: style| type| like)? {LICENCE}", None, None, ()),
    ("mpl-1.0", "licen mozilla", rf"mozilla public {LICENCE} {version(1)}", "mpl 1 0", None, ()),
    ("mpl-1.1", "mozilla", rf"mozilla public {LICENCE} {version(1, 1)}", "mpl 1 1", r"mozilla org mpl mpl 1 1(?: txt| html)?", ()),
    ("mpl-2.0", "mozilla", rf"mozilla public {LICENCE} {version(2)}", "mpl 2 0(?: no copyleft exception)?", r"mozilla org mpl 2 0",
     ("this source code form is subject to the terms of the mozilla public license v 2 0",)),
    ("mpl", "mozilla", rf"mozilla public {LICENCE}", None, r"mozilla org mpl", ()),
    ("epl-1.0", "eclipse", rf"eclipse public {LICENCE} {version(1)}", "epl 1 0", r"eclipse org legal epl v10(?: html)?", ()),
    ("epl-2.0", "eclipse", rf"eclipse public {LICENCE} {version(2)}", "epl 2 0", r"eclipse org legal epl (?:v20|2 0)(?: html)?", ()),
    ("epl", "licen eclipse", rf"eclipse public {LICENCE}", None, None, ()),
    ("edl-1.0", "eclipse", rf"eclipse distribution {LICENCE}(?: {version(1)})?", None, r"eclipse org org documents edl v10(?: html| php)?", ()),
    ("cddl-1.0", "licen development", rf"common development and distribution {LICENCE}(?: cddl)? {version(1)}", "cddl 1 0", None, ()),
    ("cddl-1.1", "licen development", rf"common development and distribution {LICENCE}(?: cddl)? {version(1, 1)}", "cddl 1 1", None, ()),
    ("cddl", "licen development", rf"common development and distribution {LICENCE}", None, None, ()),
    ("cpl-1.0", "licen common", rf"common public {LICENCE}(?: {version(1)})?", "cpl 1 0", None, ()),
    ("eupl-1.1", "licen european", rf"european union public {LICENCE}(?: eupl)? {version(1, 1)}", "eupl 1 1", None, ()),
    ("eupl-1.2", "licen european", rf"european union public {LICENCE}(?: eupl)? {version(1, 2)}", "eupl 1 2", None, ()),
    ("eupl", "licen european", rf"european union public {LICENCE}", None, None, ()),
    ("artistic-1.0", "licen artistic", rf"(?:the )?artistic {LICENCE} {version(1)}", "artistic 1 0", None, ()),
    ("artistic-2.0", "licen artistic", rf"(?:the )?artistic {LICENCE} {version(2)}", "artistic 2 0", r"opensource org licenses artistic(?: license)? 2 0(?: php| html)?", ()),
    ("artistic", "licen artistic", rf"(?:the )?artistic {LICENCE}", None, None, ()),
    ("zlib", "licen zlib", rf"(?:the )?zlib(?: libpng)? {LICENCE}", "zlib", None,
     ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",)),
    ("libpng", "licen libpng", rf"(?:the )?(?:lib)?libpng {LICENCE}", "libpng(?: 2 0)?", None, ()),
    ("bsl-1.0", "licen boost", rf"boost software {LICENCE}(?: {version(1)})?", "bsl 1 0", r"boost org license 1 0(?: txt)?", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org",
     ("this is free and unencumbered software released into the public domain",)),
    ("wtfpl", "wtfpl", rf"(?:the )?wtfpl(?: {version(2)})?", "wtfpl", r"wtfpl net", ()),
    ("cc0-1.0", "cc0", rf"(?:creative commons )?cc0(?: {version(1)})?(?: universal)?", "cc0 1 0", None, ()),
    ("cc-pdm-1.0", "domain", r"public domain mark(?: 1 0)?", None, r"creativecommons org publicdomain mark 1 0", ()),
    ("ofl-1.0", "licen font", rf"(?:sil )?open font {LICENCE} {version(1)}", "ofl 1 0", None, ()),
    ("ofl-1.1", "font", rf"(?:sil )?open font {LICENCE}(?: {version(1, 1)})?", "ofl 1 1", r"scripts sil org ofl", ()),
    ("psf-2.0", "licen", rf"(?:python software foundation|psf) {LICENCE}(?: agreement)?(?: {version(2)})?", "(?:psf|python) 2 0", None, ()),
    ("php-3.01", "licen php", rf"php {LICENCE}(?: (?:version |v )?v?3 01)?", "php 3 01", r"php net license", ()),
    ("ruby", "licen ruby", rf"ruby(?: s)? {LICENCE}", "ruby", None, ()),
    ("perl", "perl", rf"same terms as perl(?: 5)?(?: itself)?", None, None, ()),
    ("openssl", "licen openssl", rf"openssl(?: ssleay)? {LICENCE}", "openssl", None, ()),
    ("postgresql", "licen postgresql", rf"(?:the )?postgresql {LICENCE}", "postgresql", None, ()),
    ("ncsa", "licen ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LICENCE}", "ncsa", None, ()),
    ("w3c", "licen w3c", rf"w3c software(?: notice and)? {LICENCE}", "w3c", None, ()),
    ("afl-3.0", "licen academic", rf"academic free {LICENCE}(?: {version(3)})?", "afl 3 0", None, ()),
    ("osl-3.0", "licen software", rf"open software {LICENCE}(?: {version(3)})?", "osl 3 0", None, ()),
    ("ms-pl", "licen microsoft", rf"microsoft public {LICENCE}", "ms pl", None, ()),
    ("ms-rl", "licen microsoft", rf"microsoft reciprocal {LICENCE}", "ms rl", None, ()),
    ("upl-1.0", "licen universal", rf"universal permissive {LICENCE}(?: {version(1)})?", "upl 1 0", None, ()),
    ("ecl-2.0", "licen educational", rf"educational community {LICENCE}(?: {version(2)})?", "ecl 2 0", None, ()),
    ("vim", "licen vim", rf"vim {LICENCE}", "vim", None, ()),
    ("lppl-1.3c", "licen latex", rf"latex project public {LICENCE}(?: (?:version |v )?1 3c?)?", "lppl 1 3c?", None, ()),
    ("beerware", "licen beer", rf"(?:beerware|beer ware) {LICENCE}", "beerware", None, ("if we meet some day and you think this stuff is worth it you can buy me a beer in return",)),
    ("jsonlicense", "licen json", rf"(?:the )?json {LICENCE}", "json", None, ("the software shall be used for good not evil",)),
    ("odbl-1.0", "licen database", rf"open(?: data commons)? (?:open )?database {LICENCE}(?: {version(1)})?", "odbl 1 0", r"opendatacommons org licenses odbl", ()),
    ("odc-by-1.0", "licen commons", rf"open data commons attribution {LICENCE}(?: {version(1)})?", "odc by 1 0", r"opendatacommons org licenses by", ()),
    ("pddl-1.0", "commons", rf"open data commons public domain dedication(?: and {LICENCE})?", "pddl 1 0", r"opendatacommons org licenses pddl", ()),
    ("gfdl-1.2", "licen documentation", rf"(?:gnu )?free documentation {LICENCE} {version(1, 2)}{LATER}", "gfdl 1 2(?: only| or later)?", None, ()),
    ("gfdl-1.3", "licen documentation", rf"(?:gnu )?free documentation {LICENCE} {version(1, 3)}{LATER}", "gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl(?: 1 3)?(?: txt| html)?", ()),
    ("gfdl", "licen documentation", rf"(?:gnu )?free documentation {LICENCE}", None, None, ()),
    ("sspl-1.0", "licen server", rf"server side public {LICENCE}(?: {version(1)})?", "sspl 1 0", None, ()),
    ("busl-1.1", "licen business", rf"business source {LICENCE}(?: {version(1, 1)})?", "busl 1 1", None, ()),
    ("elastic-2.0", "licen elastic", rf"elastic {LICENCE}(?: {version(2)})?", "elastic 2 0", None, ()),
    ("llama", "licen llama", rf"llama (?:\d )?(?:\d )?community {LICENCE}(?: agreement)?", None, None, ()),
    ("openrail", "rail", rf"(?:creativeml |bigscience )?(?:openrail|open rail)(?: m)?(?: {LICENCE})?", "(?:creativeml |bigscience )?openrail(?: m)?", None, ()),
]

#: The copyleft family: short form, prefix of the long one, versions, address.
FAMILY = [
    ("gpl", "", [1, 2, 3], "gnu org licenses gpl"),
    ("lgpl", "(?:lesser|library) ", [2, 3], "gnu org licenses lgpl"),
    ("agpl", "affero ", [1, 3], "gnu org licenses agpl"),
]

#: Attribution licences: conditions beyond "by", how they are spelled out, versions (major, minor).
CONDITIONS = [
    ("by", "attribution"), ("by-sa", "attribution (?:sharealike|share alike)"), ("by-nd", "attribution (?:no )?(?:noderivs|noderivatives|derivs|derivatives)"),
    ("by-nc", "attribution (?:noncommercial|non commercial)"), ("by-nc-sa", "attribution (?:noncommercial|non commercial) (?:sharealike|share alike)"),
    ("by-nc-nd", "attribution (?:noncommercial|non commercial) (?:no )?(?:noderivs|noderivatives|derivs|derivatives)"),
]
CC_VERSIONS = [(1, 0), (2, 0), (2, 5), (3, 0), (4, 0)]

# The phrases that are reported wherever they stand, and their labels.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: A word of every sentence that is rarer than its licence's keywords.
SENTENCE_WORDS = [
    "hereby", "copyright", "compliance", "applicable", "redistributions", "endorse", "advertising", "mozilla", "altered", "unencumbered", "beer", "evil",
]

HINTS = [
    ("unclear", "reserved", "all rights reserved"),
    ("unclear", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("unclear", "licen", rf"see (?:the )?(?:file )?{LICENCE}(?: file| txt| md)?(?: for (?:more )?details)?"),
    ("unclear", "licen", rf"(?:licensed|released|distributed|published) under (?:a|an|the) (?:open source|free|permissive|proprietary|commercial) {LICENCE}"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|published) (?:in|into|to) the public domain"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
]

NOTICE = (
    r"(?:licensed|released|distributed|redistributed|available|provided|published|covered|governed|issued) (?:under|by|with)"
    r" (?:the |a )?(?:terms (?:and conditions )?(?:of |in )(?:the )?)?"
)
FIELD = r"licen[cs]es?(?: is| type| name| expression)? "
SPDX = "spdx license identifier "


def _forms(label: str, keywords: str, name: str, tag: str | None = None, address: str | None = None, sentences=()) -> list[Rule]:
    own = tuple(keywords.split())
    out = []
    if tag:
        out.append(Rule(label, TAG, ("spdx",), f"{SPDX}(?:{tag})"))
        out.append(Rule(label, SPOKEN, ("licen",), f"{FIELD}(?:{tag})"))
    out.append(Rule(label, SPOKEN, own, f"{NOTICE}(?:{name})"))
    if address:
        out.append(Rule(label, SPOKEN, tuple(w for w in address.split() if w.isalpha() and len(w) > 2), address))
    out += [Rule(label, SPOKEN, (next(w for w in SENTENCE_WORDS if w in s),), s) for s in sentences]
    out.append(Rule(label, NAME, own, f"(?:{name})"))
    return out


def rules() -> list[Rule]:
    """All rules, in order: of detections with equal words and level, the earlier rule's stays."""
    out = [Rule(label, NAME, ("cc-by",) if phrase == "cc by" else ("licen", phrase.split()[0]), phrase, True) for label, phrase in BASE]
    later = r"(?: of the licen[cs]e)? (?:or(?: at your option)?(?: any)? (?:later|newer)(?: version)?|plus)"
    for label, prefix, versions, address in FAMILY:
        plain = rf"(?:the )?(?:gnu )?{prefix}general public {LICENCE}(?: {label})?"
        for v in versions:
            for minor in [0, 1] if (label, v) == ("lgpl", 2) else [0]:
                tail = "(?: 0)?" if minor == 0 else f" {minor}"
                spelled, short = rf"{plain} {version(v, minor)}", rf"(?:gnu )?(?:{label} {version(v, minor)}|{label}v{v}{tail})"
                out += _forms(f"{label}-{v}.{minor}-or-later", "licen general", spelled + later, rf"{label} {v} {minor} or later")
                out += _forms(f"{label}-{v}.{minor}-or-later", label, short + later)
                out += _forms(f"{label}-{v}.{minor}", "licen general", spelled, rf"{label} {v} {minor}(?: only)?", f"{address} {v} {minor}(?: txt| html)?")
                out += _forms(f"{label}-{v}.{minor}", label, short)
        out += _forms(label, "licen general", plain, None, f"{address}(?: txt| html)?")
        out += _forms(label, f"{label} gnu", f"gnu {label}")
    for condition, spelled in CONDITIONS:
        words = condition.replace("-", " ")
        for major, minor in CC_VERSIONS:
            number = f"{major} {minor}"
            scope = "(?: international| unported| generic)?"
            address = f"creativecommons org licenses {words} {number}"
            out += _forms(f"cc-{condition}-{major}.{minor}", "cc-by", rf"cc {words}(?: {LICENCE})? (?:v |version )?v?{number}{scope}(?: {LICENCE})?", f"cc {words} {number}", address)
            out += _forms(f"cc-{condition}-{major}.{minor}", "commons", rf"creative commons {spelled} (?:v |version )?v?{number}{scope}(?: public)?(?: {LICENCE})?")
        out += _forms(f"cc-{condition}", "cc-by", rf"cc {words}(?: {LICENCE})?", None, f"creativecommons org licenses {words}")
        out += _forms(f"cc-{condition}", "commons", rf"creative commons {spelled}(?: {LICENCE})?")
    for label, keywords, name, tag, address, sentences in LICENCES:
        out += _forms(label, keywords, name, tag, address, sentences)
    return out + [Rule(label, HINT, (keyword,), signature) for label, keyword, signature in HINTS]
