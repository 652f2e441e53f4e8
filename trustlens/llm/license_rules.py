"""Signature rules for licence texts, over words (A-Z lower-cased, joined by one space).

A rule's pattern begins at its keyword: the words (or phrases of words) it may begin
with are its prefilter.  Patterns repeat no blank, so the blanks written in one bound
the words it can take, but for gaps of up to 120 characters, which are counted apart.
Lower priority numbers win over higher ones.
"""

from __future__ import annotations

from dataclasses import dataclass

IDENTIFIER, FULL_TEXT, NOTICE, NAME, HINT = 1, 2, 3, 4, 5
#: How sure a rule of each priority is.
CONFIDENCE = {IDENTIFIER: 0.99, FULL_TEXT: 0.95, NOTICE: 0.9, NAME: 0.7, HINT: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int

    @property
    def words(self) -> int:
        """The most words that the pattern can take."""
        return self.pattern.count(" ") + 1 + GAP_WORDS * self.pattern.count(GAP)


GAP = r"[^\n]{1,120}?"
GAP_WORDS = 60

VERSION = r"(?: (?:version |v ?)?[0-9]+(?: [0-9]+)?)?"
LATER = r"(?: (?:or|and) (?:\(?at your option\)? )?any later(?: version)?| or later| only)?"

# label, first words, full name as words, short name (used only after a notice form)
NAMES = [
    ("mit", ("mit",), r"mit licen[sc]e", r"mit"),
    ("mit", ("expat",), r"expat licen[sc]e", r"expat"),
    ("mit", ("x11",), r"x11 licen[sc]e", r"x11"),
    ("apache", ("apache",), rf"apache(?: software)? licen[sc]e{VERSION}", rf"apache{VERSION}"),
    ("apache", ("asl",), r"asl 2 0", r"asl 2(?: 0)?"),
    ("gpl", ("gnu",), rf"gnu (?:general public licen[sc]e|gpl){VERSION}{LATER}", rf"gnu gpl{VERSION}"),
    ("gpl", ("general",), rf"general public licen[sc]e{VERSION}{LATER}", rf"general public licen[sc]e{VERSION}{LATER}"),
    ("gpl", ("gpl", "gplv2", "gplv3"), r"gpl(?:v[23]| (?:v ?)?[23])(?: 0)?", r"gpl(?:v[23])?(?: (?:v ?)?[23])?"),
    ("lgpl", ("gnu",), rf"gnu (?:lesser|library) general public licen[sc]e{VERSION}{LATER}", rf"gnu lgpl{VERSION}"),
    ("lgpl", ("lesser", "library"), rf"(?:lesser|library) general public licen[sc]e{VERSION}{LATER}", rf"lesser gpl{VERSION}"),
    ("lgpl", ("lgpl", "lgplv2", "lgplv3"), r"lgpl(?:v[23]| (?:v ?)?[23])(?: [01])?", r"lgpl(?:v[23])?(?: (?:v ?)?[23])?"),
    ("agpl", ("gnu",), rf"gnu affero general public licen[sc]e{VERSION}{LATER}", rf"gnu agpl{VERSION}"),
    ("agpl", ("affero",), rf"affero general public licen[sc]e{VERSION}{LATER}", rf"affero gpl{VERSION}"),
    ("agpl", ("agpl", "agplv3"), r"agpl(?:v3| (?:v ?)?3)(?: 0)?", r"agpl(?:v3)?(?: (?:v ?)?3)?"),
    ("gfdl", ("gnu",), rf"gnu free documentation licen[sc]e{VERSION}{LATER}", rf"gfdl{VERSION}"),
    ("bsd", ("bsd",), r"bsd(?: (?:2|3|4|two|three|four) clause)?(?: (?:simplified|new|revised|original))? licen[sc]e", r"bsd(?: [234] clause)?"),
    ("bsd", ("new", "modified", "revised", "simplified"), r"(?:new|modified|revised|simplified) bsd(?: licen[sc]e)?", r"(?:new|modified|revised|simplified) bsd"),
    ("isc", ("isc",), r"isc licen[sc]e", r"isc"),
    ("mpl", ("mozilla",), rf"mozilla public licen[sc]e{VERSION}", rf"mozilla public licen[sc]e{VERSION}"),
    ("mpl", ("mpl",), r"mpl [12](?: [01])?", rf"mpl{VERSION}"),
    ("epl", ("eclipse",), rf"eclipse public licen[sc]e{VERSION}", rf"eclipse public licen[sc]e{VERSION}"),
    ("epl", ("epl",), r"epl [12](?: 0)?", rf"epl{VERSION}"),
    ("cddl", ("common",), rf"common development and distribution licen[sc]e{VERSION}", rf"cddl{VERSION}"),
    ("cpl", ("common",), rf"common public licen[sc]e{VERSION}", rf"cpl{VERSION}"),
    ("cc-by", ("cc",), r"cc by(?: [1-4] [05])?", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", ("cc",), r"cc by sa(?: [1-4] [05])?", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", ("cc",), r"cc by nd(?: [1-4] [05])?", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", ("cc",), r"cc by nc(?: [1-4] [05])?", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", ("cc",), r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", ("cc",), r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc0", ("cc0", "cc"), r"cc ?0(?: 1 0)?(?: universal)?", r"cc ?0"),
    ("cc-by", ("creative",), rf"creative commons attribution(?: licen[sc]e)?{VERSION}", r"creative commons attribution"),
    ("cc-by-sa", ("creative",), rf"creative commons attribution share ?alike(?: licen[sc]e)?{VERSION}", r"creative commons attribution share ?alike"),
    ("cc-by-nc", ("creative",), rf"creative commons attribution non ?commercial(?: licen[sc]e)?{VERSION}", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", ("creative",), rf"creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?{VERSION}", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc0", ("creative",), r"creative commons (?:cc0|zero)", r"creative commons zero"),
    ("boost", ("boost",), rf"boost software licen[sc]e{VERSION}", r"boost"),
    ("zlib", ("zlib",), r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("artistic", ("artistic",), rf"artistic licen[sc]e{VERSION}", rf"artistic{VERSION}"),
    ("python", ("python",), rf"python(?: software foundation)? licen[sc]e{VERSION}", r"psf"),
    ("postgresql", ("postgresql",), r"postgresql licen[sc]e", r"postgresql"),
    ("eupl", ("european",), rf"european union public licen[sc]e{VERSION}", rf"eupl{VERSION}"),
    ("ms-pl", ("microsoft",), r"microsoft public licen[sc]e", r"ms pl"),
    ("ofl", ("sil",), rf"sil open font licen[sc]e{VERSION}", rf"ofl{VERSION}"),
    ("odbl", ("open",), rf"open (?:data commons open )?database licen[sc]e{VERSION}", rf"odbl{VERSION}"),
    ("wtfpl", ("wtfpl",), rf"wtfpl{VERSION}", rf"wtfpl{VERSION}"),
    ("unlicense", ("unlicense",), r"unlicen[sc]e", r"unlicen[sc]e"),
    ("public-domain", ("public",), r"public domain(?: dedication)?", r"public domain"),
]

# What stands before a licence's name in a notice: first words, pattern
FORMS = [
    (("licensed", "licenced"), r"licen[sc]ed(?: to you)? under (?:the )?(?:terms of (?:the )?)?"),
    (("released",), r"released (?:under|into) (?:the )?(?:terms of (?:the )?)?"),
    (("distributed",), r"distributed under (?:the )?(?:terms of (?:the )?)?"),
    (("available",), r"available under (?:the )?(?:terms of (?:the )?)?"),
    (("subject",), r"subject to (?:the )?(?:terms of (?:the )?)?"),
]

# Phrases of licence texts and headers: label, first words, pattern
TEXTS = [
    ("mit", ("permission",), r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", ("permission",), r"permission is hereby granted free of charge(?: to any person)?"),
    ("isc", ("permission",), r"permission to use copy modify and(?: or)? distribute this software for any purpose"),
    ("bsd", ("redistribution",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", ("redistributions",), r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd", ("neither the name", "neither the names"), rf"neither the names? of {GAP} may be used to endorse or promote products"),
    ("apache", ("unless",), r"unless required by applicable law or agreed to in writing software"),
    ("apache", ("you",), r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", ("this",), r"this program is free software you can redistribute it and or modify it"),
    ("gpl", ("published",), r"published by the free software foundation"),
    ("lgpl", ("this",), r"this library is free software you can redistribute it and or modify it"),
    ("agpl", ("remote",), r"remote network interaction use with the gnu general public licen[sc]e"),
    ("mpl", ("this",), r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", ("altered",), r"altered source versions must be plainly marked as such"),
    ("boost", ("permission",), r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", ("this",), r"this is free and unencumbered software released into the public domain"),
    ("cc0", ("to the extent possible",), rf"to the extent possible under law {GAP} has waived all copyright"),
    ("proprietary", ("all",), r"all rights reserved"),
    ("proprietary", ("confidential",), r"confidential and proprietary"),
    ("proprietary", ("unauthorized",), r"unauthorized (?:copying|reproduction|use)(?: or distribution)? (?:of this (?:file|document|work) )?is (?:strictly )?prohibited"),
    ("proprietary", ("may",), r"may not be (?:reproduced|copied|redistributed) without(?: prior)?(?: written)? permission"),
    ("mit", ("the above copyright notice and this",), r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", ("without limitation the rights",), r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", ("in no event shall the authors",), r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", ("the author disclaims all warranties",), r"the author disclaims all warranties with regard to this software"),
    ("isc", ("provided that the above",), r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", ("this software is provided by",), rf"this software is provided by {GAP} as is and any express or implied warranties"),
    ("bsd", ("in no event shall the copyright",), r"in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental"),
    ("bsd", ("all advertising materials",), r"all advertising materials mentioning features or use of this software must display"),
    ("apache", ("grant of copyright license",), r"grant of copyright licen[sc]e subject to the terms and conditions of this licen[sc]e"),
    ("apache", ("grant of patent license",), r"grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e"),
    ("apache", ("see the license for",), r"see the licen[sc]e for the specific language governing permissions and limitations"),
    ("apache", ("you must cause any",), r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("gpl", ("you should have received",), r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", ("you should have received",), r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", ("you should have received",), r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", ("everyone is permitted",), r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl", ("the licenses for most",), r"the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom"),
    ("gpl-exception", ("as a special exception",), r"as a special exception (?:to the gnu general public licen[sc]e|the (?:free software foundation|copyright holders?) gives? (?:you )?(?:unlimited )?permission)"),
    ("gpl-exception", ("classpath exception",), r"classpath exception"),
    ("gpl-exception", ("gcc runtime library exception",), r"gcc runtime library exception"),
    ("lgpl", ("a program that contains",), r"a program that contains no derivative of any portion of the library"),
    ("gfdl", ("permission is granted to copy",), r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("mpl", ("if a copy of the mpl",), r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", ("the contents of this file",), r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("cddl", ("the contents of this file",), r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("epl", ("this program and the accompanying",), r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("zlib", ("the origin of this software",), r"the origin of this software must not be misrepresented"),
    ("zlib", ("this notice may not be",), r"this notice may not be removed or altered from any source distribution"),
    ("boost", ("must be included in all",), r"must be included in all copies of the software in whole or in part and all derivative works"),
    ("artistic", ("the intent of this document",), r"the intent of this document is to state the conditions under which a package may be copied"),
    ("python", ("psf is making python",), r"psf is making python available to licensee on an as is basis"),
    ("wtfpl", ("do what the",), r"do what the [^ ]+ you want to public licen[sc]e"),
    ("unlicense", ("anyone is free to copy",), r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", ("the person who associated",), r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", ("you must give appropriate credit",), r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", ("if you remix transform",), r"if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e"),
    ("cc-by-nc", ("you may not use the material",), r"you may not use the material for commercial purposes"),
    ("cc-by-nd", ("if you remix transform",), r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl", ("the font software may be",), r"the font software may be modified altered or added to"),
    ("ofl", ("reserved font name",), r"reserved font name"),
    ("odbl", ("this database is made",), r"this database is made available under the open database licen[sc]e"),
    ("cdla", ("community data license agreement",), r"community data licen[sc]e agreement(?: (?:permissive|sharing))?(?: version)?(?: [12] 0)?"),
    ("open-government", ("open government licence", "open government license"), r"open government licen[sc]e(?: v ?[123](?: 0)?)?"),
    ("proprietary", ("this software is the confidential",), r"this software is the confidential and proprietary information of"),
    ("proprietary", ("no part of this",), r"no part of this (?:publication|book|document|work|material|website) may be reproduced"),
    ("proprietary", ("for internal use only",), r"for internal use only"),
    ("proprietary", ("evaluation purposes only",), r"evaluation purposes only"),
    ("proprietary", ("reverse engineer decompile",), r"reverse engineer decompile(?: or)? disassemble"),
    ("non-commercial", ("for non commercial use only", "for noncommercial use only"), r"for non ?commercial use only"),
    ("non-commercial", ("for personal use only",), r"for personal use only"),
    ("research-only", ("for research purposes only",), r"for research purposes only"),
    ("research-only", ("for academic use only",), r"for academic use only"),
]

# Weak hints: they name a licence without naming which.
HINTS = [
    ("unspecified", ("licensed", "licenced"), r"licen[sc]ed under"),
    ("unspecified", ("license", "licence"), r"licen[sc]e agreement"),
    ("unspecified", ("warranty",), r"warranty of any kind"),
    ("unspecified", ("copyright",), r"copyright(?: c)? (?:19|20)[0-9]{2}"),
]


def all_rules() -> list[Rule]:
    """Every rule: names alone, names after each notice form, identifiers, texts, hints."""
    rules = [Rule(label, first, name, NAME) for label, first, name, _ in NAMES]
    rules += [Rule(label, first, form + f"(?:{name}|{short})(?: licen[sc]e)?", NOTICE)
              for label, _, name, short in NAMES for first, form in FORMS]
    rules += [Rule(label, ("spdx",), rf"spdx licen[sc]e identifier (?:{short})(?: or later| only)?", IDENTIFIER)
              for label, _, _, short in NAMES]
    rules += [Rule(label, first, text, FULL_TEXT) for label, first, text in TEXTS]
    rules += [Rule(label, first, text, HINT) for label, first, text in HINTS]
    return rules
