"""Signature rules of the license scan.

A rule is a regular expression over words (lower case, one space between, `(?: ...)?` for words that may be missing), the
keyword without which it can't match, a label and a priority (1 is the strongest). Signatures are written by hand: names, tags, short
forms, sentences and links of licenses. Names count once more for each form of words that makes a notice of them.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule: int
    keyword: str
    regex: str
    label: str
    priority: int
    base: bool


# Phrases of the contract and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, what the license is called (a regular expression over words), a keyword in every such name.
NAMES = (
    ("gpl-1.0", "gnu (?:general public license|gpl) (?:version |v)?1(?: 0)?", "gnu"),
    ("gpl-2.0", "gnu (?:general public license|gpl) (?:version |v)?2(?: 0)?", "gnu"),
    ("gpl-3.0", "gnu (?:general public license|gpl) (?:version |v)?3(?: 0)?", "gnu"),
    ("lgpl-2.0", "gnu (?:library|lesser) general public license (?:version |v)?2(?: 0)?", "general public license"),
    ("lgpl-2.1", "gnu lesser general public license (?:version |v)?2 1", "lesser general public license"),
    ("lgpl-3.0", "gnu lesser general public license (?:version |v)?3(?: 0)?", "lesser general public license"),
    ("agpl-3.0", "gnu affero general public license(?: (?:version |v)?3(?: 0)?)?", "affero"),
    ("gfdl", "gnu free documentation license(?: (?:version |v)?1 [123])?", "free documentation license"),
    ("apache-1.1", "apache (?:software )?license (?:version |v)?1 1", "apache"),
    ("apache-2.0", "apache (?:software )?license (?:version |v)?2(?: 0)?", "apache"),
    ("mit", "(?:mit|expat) license", " license"),
    ("mit-0", "mit no attribution", "no attribution"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?", "bsd"),
    ("isc", "isc license", "isc license"),
    ("mpl-1.1", "mozilla public license (?:version |v)?1 1", "mozilla"),
    ("mpl-2.0", "mozilla public license (?:version |v)?2(?: 0)?", "mozilla"),
    ("epl-1.0", "eclipse public license (?:version |v)?1(?: 0)?", "eclipse"),
    ("epl-2.0", "eclipse public license (?:version |v)?2(?: 0)?", "eclipse"),
    ("edl-1.0", "eclipse distribution license(?: (?:version |v)?1(?: 0)?)?", "eclipse"),
    ("cddl-1.0", "common development and distribution license(?: (?:version |v)?1(?: 0)?)?", "common development"),
    ("cpl-1.0", "common public license(?: (?:version |v)?1(?: 0)?)?", "common public license"),
    ("eupl-1.2", "european union public licen[cs]e(?: (?:version |v)?1 [12])?", "european union public"),
    ("artistic-1.0", "artistic license (?:version |v)?1(?: 0)?", "artistic license"),
    ("artistic-2.0", "artistic license (?:version |v)?2(?: 0)?", "artistic license"),
    ("bsl-1.0", "boost software license(?: (?:version |v)?1(?: 0)?)?", "boost software"),
    ("zlib", "zlib(?: libpng)? license", "zlib"),
    ("unlicense", "(?:the unlicense|unlicense license)", "unlicense"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("psf-2.0", "python software foundation license(?: (?:version |v)?2(?: 0)?)?", "python software foundation"),
    ("php-3.01", "php license(?: (?:version |v)?3 0?1?)?", "php license"),
    ("ruby", "ruby license", "ruby license"),
    ("openssl", "openssl license", "openssl"),
    ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    ("ms-pl", "microsoft public license", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal"),
    ("afl-3.0", "academic free license(?: (?:version |v)?3(?: 0)?)?", "academic free license"),
    ("osl-3.0", "open software license(?: (?:version |v)?3(?: 0)?)?", "open software license"),
    ("ofl-1.1", "(?:sil )?open font license(?: (?:version |v)?1 1)?", "open font license"),
    ("upl-1.0", "universal permissive license(?: (?:version |v)?1(?: 0)?)?", "universal permissive"),
    ("ecl-2.0", "educational community license(?: (?:version |v)?2(?: 0)?)?", "educational community"),
    ("lppl-1.3c", "latex project public license(?: (?:version |v)?1 3c?)?", "latex project"),
    ("postgresql", "postgresql license", "postgresql license"),
    ("mulan-2.0", "mulan permissive software license(?: (?:version |v)?2)?", "mulan"),
    ("odbl-1.0", "(?:open data commons )?open database license(?: (?:version |v)?1(?: 0)?)?", "open database license"),
    ("odc-by-1.0", "open data commons attribution license", "open data commons"),
    ("pddl-1.0", "open data commons public domain dedication(?: and license)?", "open data commons"),
    ("ogl-3.0", "open government licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "open government"),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "c"),
    ("cc-by-nc-nd", "(?:cc|creative commons) by nc nd(?: [1234] 0)?", " by nc nd"),
    ("cc-by-nc-sa", "(?:cc|creative commons) by nc sa(?: [1234] 0)?", " by nc sa"),
    ("cc-by-nc", "(?:cc|creative commons) by nc(?: [1234] 0)?", " by nc"),
    ("cc-by-nd", "(?:cc|creative commons) by nd(?: [1234] 0)?", " by nd"),
    ("cc-by-sa", "(?:cc|creative commons) by sa(?: [1234] 0)?", " by sa"),
    ("cc-by-1.0", "(?:cc|creative commons) by 1 0", " by 1 0"),
    ("cc-by-2.0", "(?:cc|creative commons) by 2 0", " by 2 0"),
    ("cc-by-3.0", "(?:cc|creative commons) by 3 0", " by 3 0"),
    ("cc-by-4.0", "(?:cc|creative commons) by 4 0", " by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0(?: international)?(?: license)?", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported)?(?: license)?", "creative commons attribution"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported)?(?: license)?", "creative commons attribution"),
)

# Forms of words around a name; what is added to the priority. A notice is stronger than a mention.
FORMS = (
    ("licen[cs]ed under(?: the)?(?: terms of)?(?: the)? {name}", "licen", 1),
    ("(?:released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? {name}", " under", 1),
    ("under the terms of(?: the)? {name}", "under the terms of", 1),
    ("spdx license identifier {name}", "spdx license identifier", 1),
    ("{name}", "", 2),
)

# Label, SPDX identifiers (after the tag; A/B are several) and the words of short forms (a regular expression, or none).
TAGS = (
    ("gpl-1.0", "GPL-1.0/GPL-1.0-only/GPL-1.0-or-later/GPL-1.0+", "gpl ?v?1(?: 0)?"), ("gpl-2.0", "GPL-2.0/GPL-2.0-only/GPL-2.0-or-later/GPL-2.0+", "gpl ?v?2(?: 0)?"), ("gpl-3.0", "GPL-3.0/GPL-3.0-only/GPL-3.0-or-later/GPL-3.0+", "gpl ?v?3(?: 0)?"),
    ("lgpl-2.0", "LGPL-2.0/LGPL-2.0-only/LGPL-2.0-or-later/LGPL-2.0+", "lgpl ?v?2(?: 0)?"), ("lgpl-2.1", "LGPL-2.1/LGPL-2.1-only/LGPL-2.1-or-later/LGPL-2.1+", "lgpl ?v?2 1"), ("lgpl-3.0", "LGPL-3.0/LGPL-3.0-only/LGPL-3.0-or-later/LGPL-3.0+", "lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "AGPL-3.0/AGPL-3.0-only/AGPL-3.0-or-later", "agpl ?v?3(?: 0)?"), ("gfdl", "GFDL-1.1/GFDL-1.2/GFDL-1.3/GFDL-1.1-only/GFDL-1.2-only/GFDL-1.3-only/GFDL-1.1-or-later/GFDL-1.2-or-later/GFDL-1.3-or-later", None),
    ("apache-1.1", "Apache-1.1", "apache 1 1"), ("apache-2.0", "Apache-2.0", "apache (?:v ?)?2 0"), ("mit", "MIT", None), ("mit-0", "MIT-0", None),
    ("bsd-2-clause", "BSD-2-Clause", None), ("bsd-3-clause", "BSD-3-Clause", None), ("bsd-4-clause", "BSD-4-Clause", None), ("0bsd", "0BSD", None), ("isc", "ISC", None),
    ("mpl-1.1", "MPL-1.1", "mpl ?v?1 1"), ("mpl-2.0", "MPL-2.0", "mpl ?v?2 0"), ("epl-1.0", "EPL-1.0", "epl ?v?1 0"), ("epl-2.0", "EPL-2.0", "epl ?v?2 0"), ("edl-1.0", "EDL-1.0", None),
    ("cddl-1.0", "CDDL-1.0", "cddl 1 0"), ("cpl-1.0", "CPL-1.0", None), ("eupl-1.2", "EUPL-1.1/EUPL-1.2", "eupl ?v?1 [12]"), ("artistic-1.0", "Artistic-1.0", "artistic 1 0"), ("artistic-2.0", "Artistic-2.0", "artistic 2 0"),
    ("bsl-1.0", "BSL-1.0", None), ("zlib", "Zlib", None), ("unlicense", "Unlicense", None), ("wtfpl", "WTFPL", "wtfpl"), ("psf-2.0", "PSF-2.0/Python-2.0", None), ("php-3.01", "PHP-3.01", None), ("ruby", "Ruby", None),
    ("openssl", "OpenSSL", None), ("ncsa", "NCSA", None), ("ms-pl", "MS-PL", None), ("ms-rl", "MS-RL", None), ("afl-3.0", "AFL-3.0", None), ("osl-3.0", "OSL-3.0", None), ("ofl-1.1", "OFL-1.1", None), ("upl-1.0", "UPL-1.0", None),
    ("ecl-2.0", "ECL-2.0", None), ("lppl-1.3c", "LPPL-1.3c", None), ("postgresql", "PostgreSQL", None), ("mulan-2.0", "MulanPSL-2.0", None), ("odbl-1.0", "ODbL-1.0", None), ("odc-by-1.0", "ODC-By-1.0", None), ("pddl-1.0", "PDDL-1.0", None),
    ("ogl-3.0", "OGL-UK-3.0", None), ("cc0-1.0", "CC0-1.0", None), ("cc-by-nc-nd", "CC-BY-NC-ND-3.0/CC-BY-NC-ND-4.0", None), ("cc-by-nc-sa", "CC-BY-NC-SA-3.0/CC-BY-NC-SA-4.0", None), ("cc-by-nc", "CC-BY-NC-3.0/CC-BY-NC-4.0", None),
    ("cc-by-nd", "CC-BY-ND-3.0/CC-BY-ND-4.0", None), ("cc-by-sa", "CC-BY-SA-3.0/CC-BY-SA-4.0", None), ("cc-by-1.0", "CC-BY-1.0", None), ("cc-by-2.0", "CC-BY-2.0", None), ("cc-by-3.0", "CC-BY-3.0", None), ("cc-by-4.0", "CC-BY-4.0", None),
)

# Rules of their own: label, regular expression, keyword, priority.
TEXTS = (
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version", "any later version", 1),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version", "any later version", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 1),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy", 1),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license", 1),
    ("apache-2.0", "www apache org licenses license 2 0", "apache org licenses", 1),
    ("gpl", "www gnu org licenses(?: gpl)?", "gnu org licenses", 1),
    ("cc-by", "creativecommons org licenses by(?: [1234] 0)?", "creativecommons org licenses", 1),
    ("cc0-1.0", "creativecommons org publicdomain zero(?: 1 0)?", "creativecommons org publicdomain", 1),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form", 1),
    ("public-domain", "(?:placed in|released into|dedicated to) the public domain", "the public domain", 2),
    ("proprietary", "all rights reserved", "all rights reserved", 4),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "confidential", 3),
    ("copyright-notice", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", 4),
    ("no-warranty", "(?:without warranty of any kind|without warranties or conditions of any kind)", "of any kind", 4),
    ("unspecified", "(?:see|read) the license(?: file)?", "the license", 4),
    ("unspecified", "licen[cs]ed under", "licen", 4),
)


# Headers, clauses and links of license texts: label, regular expression, keyword, priority. A sentence that only one
# license has is a notice (1), one that a family shares a mention (2), one of many licenses a hint (4).
CLAUSES = (
    # GNU licenses
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "this program is free software", 1),
    ("gpl", "you should have received a copy of the gnu general public license along with this", "you should have received a copy", 1),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "this library is free software", 1),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "you should have received a copy", 1),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license", "you should have received a copy", 1),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies of this license", 1),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom", 1),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft license for", 1),
    ("gpl-3.0", "no covered work shall be deemed part of an effective technological measure", "effective technological measure", 1),
    ("gpl-2.0", "this license applies to any program or other work which contains a notice placed by the copyright holder", "which contains a notice placed", 1),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it", "copy and distribute verbatim copies", 1),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it", "convey verbatim copies", 1),
    ("gpl-2.0-only", "version 2 of the license as published by the free software foundation", "published by the free software foundation", 2),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied warranty", 2),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely", 1),
    ("agpl-3.0", "remote network interaction use with the gnu general public license", "remote network interaction", 1),
    ("lgpl-2.1", "a work that uses the library", "uses the library", 2),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lesser general public license incorporates", 1),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation license", 1),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections", 1),
    ("gcc-exception", "gcc runtime library exception", "runtime library exception", 1),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", "statically or dynamically", 1),
    ("openssl-exception", "permission to link the code of portions of this program with the openssl library", "with the openssl library", 1),
    ("font-exception", "this font does not by itself cause the resulting document to be covered", "this font does not by itself", 1),
    # permissive licenses of universities and vendors
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "deal in the software without restriction", 1),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "all copies or substantial portions", 1),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders be liable", 2),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "other dealings in this software", 1),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "furnished to do so the software is provided", 1),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee", 1),
    ("isc", "the author disclaims all warranties with regard to this software", "disclaims all warranties with regard", 2),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "software and its documentation for any purpose", 1),
    ("hpnd", "the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation", "appear in supporting documentation", 1),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code", 1),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", 1),
    ("bsd-3-clause", "neither the name of .{1,60}? nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors", 1),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived", 1),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "all advertising materials mentioning", 1),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is", "this software is provided by the", 2),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to those receiving rights under this license", "each copyright holder and contributor", 1),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent rights are granted by this license", 1),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "is hereby granted the software is provided", 1),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty", 2),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "origin of this software must not", 1),
    ("zlib", "altered source versions must be plainly marked as such", "altered source versions", 1),
    ("zlib", "this notice may not be removed or altered from any source distribution", "may not be removed or altered", 2),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining", 1),
    ("bsl-1.0", "must be included in all copies of the software in whole or in part and all derivative works", "in whole or in part and all derivative", 1),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "to deal with the software without restriction", 1),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear in all copies", 2),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement", 1),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files", 1),
    ("icu", "icu license icu 1 8 1 and later", "icu license", 1),
    ("libpng", "the png reference library is supplied as is", "png reference library", 1),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group", 1),
    ("freetype", "portions of this software are copyright .{1,40}? the freetype project", "the freetype project", 1),
    ("info-zip", "this is version .{1,30}? of the info zip license", "info zip license", 1),
    ("bzip2", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product", "if you use this software in a product", 2),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "authors hereby grant permission", 1),
    ("vim", "vim is charityware", "charityware", 1),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "whatever you want with this stuff", 1),
    ("wtfpl", "you just do what the fuck you want to", "the fuck you", 1),
    ("json", "the software shall be used for good not evil", "not evil", 1),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", "usage of the works is permitted", 1),
    ("naumen", "naumen public license", "naumen", 1),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that", "is hereby granted provided that", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 1),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish", 1),
    # Apache, Mozilla, Eclipse and other licenses with patents or weak copyleft
    ("apache-2.0", "licensed under the apache license version 2 0 the license", "apache license version 2 0 the license", 1),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law", 1),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", "for use reproduction and distribution", 1),
    ("apache-2.0", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license", "licensor shall mean", 1),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants to you", 1),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", 1),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse", "the names apache", 1),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject to", 1),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed", 1),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses", "incompatible with secondary licenses", 1),
    ("npl-1.1", "netscape public license", "netscape public license", 1),
    ("epl", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license", "this program and the accompanying materials", 1),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials", 1),
    ("epl", "www eclipse org legal epl", "eclipse org legal", 1),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", "terms of this common public license", 1),
    ("ipl-1.0", "ibm public license", "ibm public license", 1),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development", 1),
    ("cddl-1.0", "when distributing covered code include this cddl header", "cddl header", 1),
    ("apsl-2.0", "apple public source license", "apple public source", 1),
    ("cpal-1.0", "common public attribution license", "common public attribution", 1),
    ("rpl-1.5", "reciprocal public license", "reciprocal public license", 1),
    ("qpl-1.0", "q public license", "q public license", 1),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "accompanied by information on how", 1),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software license", 1),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license", 1),
    ("eupl-1.2", "you may not use this work except in compliance with the licence", "this work except in compliance", 1),
    ("cecill", "cecill (?:free software )?license(?: agreement)?", "cecill", 1),
    ("artistic-2.0", "the artistic license 2 0 preamble|this license establishes the terms under which a given free software package may be copied", "artistic license", 1),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself", "same terms as perl itself", 1),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "2 clause bsdl", 1),
    ("psf-2.0", "this license agreement is between the python software foundation psf and the individual or organization", "python software foundation psf", 1),
    ("php-3.01", "this product includes php software freely available from", "this product includes php", 1),
    ("openssl", "this product includes software developed by the openssl project", "the openssl project", 1),
    ("ssleay", "this product includes cryptographic software written by eric young", "written by eric young", 1),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "governs use of the accompanying software", 1),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "subject to the condition set forth below", 1),
    ("mulan-2.0", "you can use this software according to the terms and conditions of the mulan psl", "mulan psl", 1),
    ("lppl-1.3c", "this work may be distributed and or modified under the conditions of the latex project public license", "latex project", 1),
    ("w3c", "w3c software (?:and document )?(?:notice and )?license", "w3c software", 1),
    ("ecl-2.0", "licensed under the educational community license version 2 0", "educational community", 1),
    ("watcom", "sybase open watcom public license", "open watcom", 1),
    ("intel", "intel open source license", "intel open source", 1),
    ("nasa", "nasa open source agreement", "nasa open source", 1),
    ("sissl", "sun industry standards source license", "sun industry standards", 1),
    ("erlang", "erlang public license", "erlang public license", 1),
    ("motosoto", "motosoto open source license", "motosoto", 1),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "this font software", 1),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "neither the font software", 1),
    ("bitstream-vera", "bitstream vera fonts copyright", "bitstream vera", 1),
    ("ubuntu-font", "ubuntu font licen[cs]e", "ubuntu font", 1),
    # licenses that limit use
    ("sspl-1.0", "server side public license", "server side public license", 1),
    ("bsl-1.1", "business source license(?: 1 1)?", "business source license", 1),
    ("bsl-1.1", "effective on the change date or the fourth anniversary of the first publicly available distribution", "on the change date", 1),
    ("elastic-2.0", "elastic license(?: 2 0)?", "elastic license", 1),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service", 1),
    ("commons-clause", "commons clause license condition", "commons clause", 1),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|internal use) license", "polyform", 1),
    ("confluent", "confluent community license", "confluent community", 1),
    ("redis", "redis source available license", "redis source available", 1),
    ("openrail", "(?:creative ml|bigscience|bigcode) open ?rail(?: m)?", "rail", 1),
    ("llama", "llama [0-9](?: [0-9])? community license(?: agreement)?", "community license", 1),
    ("gemma", "gemma terms of use", "gemma terms", 1),
    ("research-only", "for (?:non commercial )?research (?:use|purposes) only", "research", 3),
    ("research-only", "for academic (?:use|purposes) only", "for academic", 3),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", "commercial", 3),
    ("evaluation", "for (?:internal )?evaluation purposes only", "evaluation purposes only", 3),
    ("personal-use", "free for personal use", "free for personal use", 3),
    # content licenses and the public domain
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", "copy and redistribute the material", 1),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "give appropriate credit", 1),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "under the same license as the original", 1),
    ("cc-by-nc", "you may not use the material for commercial purposes", "the material for commercial purposes", 1),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "may not distribute the modified material", 1),
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution", "licensed under", 1),
    ("cc-by-sa", "creativecommons org licenses by sa(?: [1234] 0)?", "creativecommons org licenses", 1),
    ("cc-by-nc", "creativecommons org licenses by nc(?: [1234] 0)?", "creativecommons org licenses", 1),
    ("cc-by-nd", "creativecommons org licenses by nd(?: [1234] 0)?", "creativecommons org licenses", 1),
    ("cc0-1.0", "to the extent possible under law .{1,60}? has waived all copyright and related or neighboring rights", "waived all copyright", 1),
    ("cc0-1.0", "no rights reserved", "no rights reserved", 2),
    ("pdm-1.0", "creativecommons org publicdomain mark", "creativecommons org publicdomain", 1),
    ("public-domain", "(?:this (?:work|file|code|software) is|is) in the public domain", "in the public domain", 2),
    ("public-domain", "no copyright is claimed|the author disclaims copyright to this source code", "copyright", 2),
    ("us-government", "this is a work of the u s government and is not subject to copyright protection", "work of the u s government", 1),
    ("odbl-1.0", "opendatacommons org licenses odbl", "opendatacommons org", 1),
    ("odc-by-1.0", "opendatacommons org licenses by", "opendatacommons org", 1),
    ("pddl-1.0", "opendatacommons org licenses pddl", "opendatacommons org", 1),
    ("cdla-permissive", "community data license agreement permissive", "community data license agreement", 1),
    ("cdla-sharing", "community data license agreement sharing", "community data license agreement", 1),
    ("ogl-3.0", "contains public sector information licensed under the open government licen[cs]e", "public sector information", 1),
    ("etalab", "licence ouverte(?: open licence)?", "licence ouverte", 1),
    ("gutenberg", "this ebook is for the use of anyone anywhere", "for the use of anyone anywhere", 1),
    # links
    ("mit", "opensource org licenses mit", "opensource org licenses", 1),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", "opensource org licenses", 1),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", "opensource org licenses", 1),
    ("isc", "opensource org licenses isc", "opensource org licenses", 1),
    ("apache-2.0", "opensource org licenses apache 2 0", "opensource org licenses", 1),
    ("mpl-2.0", "mozilla org mpl 2 0|mozilla org en us mpl 2 0", "mozilla org", 1),
    ("bsl-1.0", "boost org license 1 0(?: txt)?", "boost org license", 1),
    ("ofl-1.1", "scripts sil org ofl", "sil org ofl", 1),
    ("unlicense", "unlicense org", "unlicense org", 1),
    ("lgpl", "gnu org licenses lgpl", "gnu org licenses", 1),
    ("agpl-3.0", "gnu org licenses agpl", "gnu org licenses", 1),
    ("gfdl", "gnu org licenses fdl", "gnu org licenses", 1),
    # hints
    ("unspecified", "for (?:full|complete|more|further) licen[cs]e (?:details|information|terms)", "licen", 4),
    ("unspecified", "(?:refer to|included in|found in) the licen[cs]e file", "the licen", 4),
    ("unspecified", "subject to the terms (?:and conditions )?of (?:the|this) licen[cs]e", "subject to the terms", 4),
    ("unspecified", "use of this source code is governed by", "source code is governed by", 4),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution)", "unauthorized", 3),
    ("proprietary", "may not be (?:copied|reproduced|distributed|redistributed) without (?:the )?(?:express |prior )*(?:written )?permission", "permission", 3),
    ("proprietary", "this software is the (?:confidential and )?proprietary (?:information|property) of", "this software is the", 2),
    ("proprietary", "trade secrets? of", "trade secret", 3),
    ("proprietary", "end user licen[cs]e agreement", "end user licen", 3),
    ("proprietary", "you may not reverse engineer decompile or disassemble", "reverse engineer", 3),
    ("no-warranty", "provided as is without warranty", "as is without warranty", 4),
    ("no-warranty", "the entire risk as to the quality and performance", "the entire risk", 4),
    ("no-liability", "be liable for any (?:direct|indirect|special|incidental|consequential)", "be liable for any", 4),
    ("copyright-notice", "copyrighted material", "copyrighted material", 4),
)


def rules() -> list[Rule]:
    """All rules, numbered in order. A base rule has the weakest priority but is never dropped from what is counted."""
    out = [Rule(i, phrase, phrase, label, 3, True) for i, (phrase, label) in enumerate(BASE)]
    for label, name, keyword in NAMES:
        for form, gate, strength in FORMS:
            out.append(Rule(len(out), gate if gate.startswith("spdx") else keyword, form.format(name=name), label, strength, False))
    out += [Rule(len(out) + i, keyword, f"(?:{regex})" if "|" in regex else regex, label, priority, False) for i, (label, regex, keyword, priority) in enumerate((*TEXTS, *CLAUSES))]
    for label, ids, short in TAGS:
        # "+" is no word; of several identifiers the longest is tried first
        forms = sorted({i.lower().replace("-", " ").replace(".", " ").rstrip("+") for i in ids.split("/")}, key=lambda i: (-len(i), i))
        out.append(Rule(len(out), "spdx license identifier", f"spdx license identifier (?:{'|'.join(forms)})", label, 1, False))
        if short:
            out.append(Rule(len(out), f" {short.split(' ')[0]}", short, label, 2, False))
    return out
