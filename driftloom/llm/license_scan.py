"""License scans: ordered signature rules over words, in DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A cheap test
for a few strings decides whether a text can hold any signature; for the others only words
are counted. Where it can, each word that begins some rule (its keyword) is an anchor: the
words from there on, as many as its longest rule can take and joined by single spaces, are matched against that keyword's
rules only, each an anchored regular expression with a label and a priority. A match is an
interval of words. Intervals are sorted by start, longest first and highest priority first, and
folded once: one that lies within an interval before it of the same or a higher priority is
suppressed, unless its rule is a base rule.

Result for each document: doc_id, n_words, n_base (places of base phrases), first_word and
last_word (their smallest and largest start, from 0; null without any), base_labels, labels
(those of kept matches, and all base ones; both distinct, sorted, comma-joined, empty without
any), score (share of the highest priority reached, 0 without a match), n_matches (kept ones).
Null text counts as empty; repeated rows give repeated rows; null doc_id stays null;
other columns are ignored. All is one projection: no shuffle, and memory follows one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that are no part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOP = 5

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_V = r"(?: (?:version|v))? ?"
_LIC = r"(?: (?:software )?licen[sc]e)"
#: Hand-written signatures: (label, priority, regular expression from an anchor word on). A
#: higher priority is the more specific statement: 5 identifier, 4 title with version, 3 title,
#: 2 notice, 1 hint.
WRITTEN = (
    ("gpl", 3, r"gnu general public licen[sc]e"),
    ("gpl", 3, r"gnu gpl"),
    ("gpl", 2, r"gpl"),
    ("gpl", 2, r"gplv?[123]"),
    ("gpl-2.0", 4, r"gnu general public licen[sc]e" + _V + r"2(?: 0)?"),
    ("gpl-3.0", 4, r"gnu general public licen[sc]e" + _V + r"3(?: 0)?"),
    ("gpl-2.0", 4, r"gpl" + _V + r"2(?: 0)?"),
    ("gpl-3.0", 4, r"gpl" + _V + r"3(?: 0)?"),
    ("gpl-2.0-or-later", 4, r"gnu general public licen[sc]e(?: as published by the free software foundation either)?" + _V + r"2 (?:of the license )?or at your option any later version"),
    ("gpl-3.0-or-later", 4, r"gnu general public licen[sc]e(?: as published by the free software foundation either)?" + _V + r"3 (?:of the license )?or at your option any later version"),
    ("lgpl", 3, r"gnu lesser general public licen[sc]e"),
    ("lgpl", 3, r"gnu library general public licen[sc]e"),
    ("lgpl-2.1", 4, r"gnu lesser general public licen[sc]e" + _V + r"2 1"),
    ("lgpl-3.0", 4, r"gnu lesser general public licen[sc]e" + _V + r"3(?: 0)?"),
    ("lgpl-2.1", 4, r"lgpl" + _V + r"2 1"),
    ("lgpl-3.0", 4, r"lgpl" + _V + r"3(?: 0)?"),
    ("agpl", 3, r"gnu affero general public licen[sc]e"),
    ("agpl-3.0", 4, r"gnu affero general public licen[sc]e" + _V + r"3(?: 0)?"),
    ("agpl-3.0", 4, r"agpl" + _V + r"3(?: 0)?"),
    ("gfdl", 3, r"gnu free documentation licen[sc]e"),
    ("gfdl-1.3", 4, r"gnu free documentation licen[sc]e" + _V + r"1 3"),
    ("apache", 3, r"apache (?:software )?licen[sc]e"),
    ("apache-2.0", 4, r"apache (?:software )?licen[sc]e" + _V + r"2(?: 0)?"),
    ("apache-1.1", 4, r"apache (?:software )?licen[sc]e" + _V + r"1 1"),
    ("apache-2.0", 2, r"licensed under the apache licen[sc]e" + _V + r"2(?: 0)?"),
    ("mit", 3, r"mit licen[sc]e"),
    ("mit", 2, r"released under the mit licen[sc]e"),
    ("mit", 2, r"licensed under the mit licen[sc]e"),
    ("mit", 2, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 1, r"the above copyright notice and this permission notice shall be included"),
    ("isc", 3, r"isc licen[sc]e"),
    ("isc", 2, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, r"bsd licen[sc]e"),
    ("bsd-2-clause", 4, r"(?:simplified bsd|bsd 2 clause)" + _LIC + r"?"),
    ("bsd-3-clause", 4, r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause)" + _LIC + r"?"),
    ("bsd-4-clause", 4, r"(?:original bsd|bsd 4 clause)" + _LIC + r"?"),
    ("bsd", 2, r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", 1, r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", 1, r"neither the name of"),
    ("mpl", 3, r"mozilla public licen[sc]e"),
    ("mpl-2.0", 4, r"mozilla public licen[sc]e" + _V + r"2(?: 0)?"),
    ("mpl-1.1", 4, r"mozilla public licen[sc]e" + _V + r"1 1"),
    ("mpl-2.0", 4, r"mpl" + _V + r"2(?: 0)?"),
    ("epl", 3, r"eclipse public licen[sc]e"),
    ("epl-1.0", 4, r"eclipse public licen[sc]e" + _V + r"1(?: 0)?"),
    ("epl-2.0", 4, r"eclipse public licen[sc]e" + _V + r"2(?: 0)?"),
    ("cddl", 3, r"common development and distribution licen[sc]e"),
    ("cddl-1.0", 4, r"common development and distribution licen[sc]e" + _V + r"1(?: 0)?"),
    ("eupl", 3, r"european union public licen[sc]e"),
    ("artistic", 3, r"artistic licen[sc]e"),
    ("artistic-2.0", 4, r"artistic licen[sc]e" + _V + r"2(?: 0)?"),
    ("zlib", 3, r"zlib licen[sc]e"),
    ("boost-1.0", 3, r"boost software licen[sc]e"),
    ("unlicense", 3, r"the unlicense"),
    ("unlicense", 2, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, r"do what the fuck you want to public licen[sc]e"),
    ("ofl-1.1", 3, r"sil open font licen[sc]e"),
    ("odbl", 3, r"open database licen[sc]e"),
    ("cc0", 4, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 2, r"creative commons zero"),
    ("cc", 2, r"creative commons"),
    ("cc-by", 3, r"creative commons attribution"),
    ("cc-by-sa", 3, r"creative commons attribution share ?alike"),
    ("cc-by-nc", 3, r"creative commons attribution non ?commercial"),
    ("cc-by-nd", 3, r"creative commons attribution no ?derivati(?:ve|ves|ons)"),
    ("cc-by-nc-sa", 3, r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 3, r"creative commons attribution non ?commercial no ?derivati(?:ve|ves|ons)"),
    ("public-domain", 2, r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 1, r"public domain"),
    ("proprietary", 2, r"proprietary and confidential"),
    ("proprietary", 1, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("gpl-1.0", 4, r"gnu general public licen[sc]e" + _V + r"1(?: 0)?"),
    ("gpl-2.0-only", 4, r"gnu general public licen[sc]e version 2 only"),
    ("gpl-3.0-only", 4, r"gnu general public licen[sc]e version 3 only"),
    ("gpl", 2, r"this (?:program|file|package|script) is free software you (?:can|may) redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 2, r"this (?:library|package|module) is free software you (?:can|may) redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("gpl", 1, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 1, r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("agpl", 1, r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("lgpl-2.0", 4, r"gnu library general public licen[sc]e" + _V + r"2(?: 0)?"),
    ("lgpl-2.1-or-later", 4, r"gnu lesser general public licen[sc]e(?: as published by the free software foundation either)? version 2 1 (?:of the licen[sc]e )?or at your option any later version"),
    ("lgpl-3.0-or-later", 4, r"gnu lesser general public licen[sc]e(?: as published by the free software foundation either)? version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("agpl-3.0-or-later", 4, r"gnu affero general public licen[sc]e(?: as published by the free software foundation either)? version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("gfdl-1.1", 4, r"gnu free documentation licen[sc]e" + _V + r"1 1"),
    ("gfdl-1.2", 4, r"gnu free documentation licen[sc]e" + _V + r"1 2"),
    ("gfdl", 2, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("classpath-exception", 3, r"classpath exception"),
    ("gcc-exception", 3, r"gcc runtime library exception"),
    ("font-exception", 3, r"font (?:embedding )?exception"),
    ("linking-exception", 3, r"(?:static|openssl) linking exception"),
    ("linux-syscall-note", 3, r"linux syscall (?:note|exception)"),
    ("apache-1.0", 4, r"apache (?:software )?licen[sc]e" + _V + r"1 0"),
    ("apache-2.0", 2, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 2, r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", 2, r"asf licenses this file to you under the apache licen[sc]e"),
    ("apache-2.0", 1, r"the licen[sc]e is distributed on an as is basis"),
    ("apache-1.1", 1, r"redistribution and use of this software developed by the apache software foundation"),
    ("mit", 2, r"distributed under the (?:terms of the )?mit licen[sc]e"),
    ("mit", 3, r"expat licen[sc]e"),
    ("mit", 2, r"(?:licensed|licenced) under mit"),
    ("mit-0", 4, r"mit no attribution(?: licen[sc]e)?"),
    ("x11", 3, r"(?:x11|mit x11|x consortium) licen[sc]e"),
    ("mit", 1, r"software is provided as is without warranty of any kind express or implied"),
    ("mit", 1, r"copies of the software and to permit persons to whom the software is furnished to do so subject to"),
    ("mit-cmu", 3, r"cmu licen[sc]e"),
    ("hpnd", 2, r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", 3, r"historical permission notice and disclaimer"),
    ("ntp", 3, r"ntp licen[sc]e"),
    ("bsd-0-clause", 4, r"(?:zero clause bsd|bsd zero clause)" + _LIC + r"?"),
    ("bsd-1-clause", 4, r"bsd 1 clause" + _LIC + r"?"),
    ("bsd-3-clause-clear", 4, r"(?:clear bsd|bsd 3 clause clear)" + _LIC + r"?"),
    ("bsd-2-clause-patent", 4, r"bsd 2 clause (?:plus )?patent" + _LIC + r"?"),
    ("bsd", 2, r"(?:licensed|licenced) under the (?:terms of the )?bsd licen[sc]e"),
    ("bsd", 2, r"bsd style licen[sc]e"),
    ("bsd", 1, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, r"neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 2, r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", 1, r"any express or implied warranties including but not limited to"),
    ("isc", 1, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", 2, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 3, r"zlib libpng licen[sc]e"),
    ("libpng", 3, r"(?:libpng|png reference library) licen[sc]e"),
    ("boost-1.0", 4, r"boost software licen[sc]e" + _V + r"1(?: 0)?"),
    ("boost-1.0", 2, r"distributed under the boost software licen[sc]e"),
    ("mpl-1.0", 4, r"mozilla public licen[sc]e" + _V + r"1 0"),
    ("mpl-2.0", 2, r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", 2, r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl-2.0-no-copyleft-exception", 4, r"incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("npl", 3, r"netscape public licen[sc]e"),
    ("epl", 2, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("edl", 3, r"eclipse distribution licen[sc]e"),
    ("cddl", 2, r"the contents of this file are subject to the terms of (?:either the gnu general public licen[sc]e or )?the common development and distribution licen[sc]e"),
    ("cddl-1.1", 4, r"common development and distribution licen[sc]e" + _V + r"1 1"),
    ("cpl", 3, r"common public licen[sc]e"),
    ("cpl-1.0", 4, r"common public licen[sc]e" + _V + r"1(?: 0)?"),
    ("ipl", 3, r"ibm public licen[sc]e"),
    ("cpal", 3, r"common public attribution licen[sc]e"),
    ("eupl-1.1", 4, r"european union public licen[sc]e" + _V + r"1 1"),
    ("eupl-1.2", 4, r"european union public licen[sc]e" + _V + r"1 2"),
    ("cecill", 3, r"cecill (?:free software )?licen[sc]e"),
    ("apsl", 3, r"apple public source licen[sc]e"),
    ("spl", 3, r"sun public licen[sc]e"),
    ("sissl", 3, r"sun industry standards source licen[sc]e"),
    ("ms-pl", 3, r"microsoft public licen[sc]e"),
    ("ms-rl", 3, r"microsoft reciprocal licen[sc]e"),
    ("ms-eula", 2, r"microsoft software licen[sc]e terms"),
    ("nasa", 3, r"nasa open source agreement(?: version)? licen[sc]e"),
    ("intel", 3, r"intel (?:open|simplified) (?:source|software) licen[sc]e"),
    ("osl-3.0", 4, r"open software licen[sc]e" + _V + r"3(?: 0)?"),
    ("osl", 3, r"open software licen[sc]e"),
    ("afl", 3, r"academic free licen[sc]e"),
    ("afl-3.0", 4, r"academic free licen[sc]e" + _V + r"3(?: 0)?"),
    ("ecl-2.0", 3, r"educational community licen[sc]e"),
    ("psf", 3, r"python software foundation licen[sc]e(?: agreement)?"),
    ("psf", 3, r"psf licen[sc]e(?: agreement)?"),
    ("cnri", 3, r"cnri (?:open source )?licen[sc]e"),
    ("php", 3, r"php licen[sc]e"),
    ("ruby", 3, r"ruby s? ?licen[sc]e"),
    ("perl", 2, r"licensed under the same terms as perl itself"),
    ("artistic-1.0", 4, r"artistic licen[sc]e" + _V + r"1(?: 0)?"),
    ("clarified-artistic", 3, r"clarified artistic licen[sc]e"),
    ("zpl", 3, r"zope public licen[sc]e"),
    ("w3c", 3, r"w3c (?:software|document) (?:notice and )?licen[sc]e"),
    ("unicode", 3, r"unicode (?:inc )?licen[sc]e agreement"),
    ("openssl", 3, r"openssl licen[sc]e"),
    ("ssleay", 3, r"ssleay licen[sc]e"),
    ("postgresql", 3, r"postgresql licen[sc]e"),
    ("vim", 3, r"vim licen[sc]e"),
    ("lppl", 3, r"latex project public licen[sc]e"),
    ("tcl", 3, r"tcl tk licen[sc]e"),
    ("sleepycat", 3, r"sleepycat (?:public )?licen[sc]e"),
    ("beerware", 3, r"(?:beerware|beer ware) licen[sc]e"),
    ("json", 3, r"json licen[sc]e"),
    ("sspl", 3, r"server side public licen[sc]e"),
    ("busl-1.1", 3, r"business source licen[sc]e"),
    ("elastic-2.0", 3, r"elastic licen[sc]e"),
    ("commons-clause", 3, r"commons clause licen[sc]e condition"),
    ("polyform", 3, r"polyform (?:noncommercial|shield|strict|perimeter|small business|internal use) licen[sc]e"),
    ("rsal", 3, r"redis source available licen[sc]e"),
    ("confluent", 3, r"confluent community licen[sc]e"),
    ("mulan-psl", 3, r"mulan (?:permissive|public) (?:software )?licen[sc]e"),
    ("qpl", 3, r"q public licen[sc]e"),
    ("rpl", 3, r"reciprocal public licen[sc]e"),
    ("rpsl", 3, r"realnetworks public source licen[sc]e"),
    ("nokia", 3, r"nokia open source licen[sc]e"),
    ("lpl", 3, r"lucent public licen[sc]e"),
    ("vsl", 3, r"vovida software licen[sc]e"),
    ("efl", 3, r"eiffel forum licen[sc]e"),
    ("fair", 3, r"fair licen[sc]e"),
    ("lal", 3, r"(?:free art licen[sc]e|licence art libre)"),
    ("ogl", 3, r"open (?:game|government|publication|data) licen[sc]e"),
    ("odc-by", 3, r"open data commons attribution licen[sc]e"),
    ("pddl", 3, r"public domain dedication and licen[sc]e"),
    ("cdla", 3, r"community data licen[sc]e agreement"),
    ("ufl", 3, r"ubuntu font licen[sc]e"),
    ("bitstream-vera", 3, r"bitstream vera fonts? (?:copyright|licen[sc]e)"),
    ("gust", 3, r"gust font licen[sc]e"),
    ("ipa", 3, r"ipa font licen[sc]e"),
    ("openrail", 3, r"(?:openrail|open rail|bigscience|bigcode) (?:m |open ?rail m )?(?:model )?licen[sc]e"),
    ("rail", 3, r"responsible ai licen[sc]e"),
    ("llama", 3, r"(?:llama|gemma) (?:[0-9] )?(?:community )?licen[sc]e(?: agreement)?"),
    ("upl-1.0", 3, r"universal permissive licen[sc]e"),
    ("blueoak-1.0.0", 3, r"blue oak model licen[sc]e"),
    ("ncsa", 3, r"ncsa open source licen[sc]e"),
    ("ncsa", 3, r"university of illinois (?:ncsa )?open source licen[sc]e"),
    ("sgi-b", 3, r"sgi free software licen[sc]e"),
    ("imagemagick", 3, r"imagemagick licen[sc]e"),
    ("ftl", 3, r"freetype (?:project )?licen[sc]e"),
    ("info-zip", 3, r"info zip licen[sc]e"),
    ("curl", 3, r"curl licen[sc]e"),
    ("wxwindows", 3, r"wxwindows library licen[sc]e"),
    ("xfree86", 3, r"xfree86 licen[sc]e"),
    ("hippocratic", 3, r"hippocratic licen[sc]e"),
    ("parity", 3, r"(?:parity|prosperity) public licen[sc]e"),
    ("wtfpl", 2, r"wtfpl licen[sc]e"),
    ("unlicense", 2, r"anyone is free to copy modify publish use compile sell or distribute this software public domain"),
    ("public-domain", 2, r"creative commons public domain (?:mark|dedication)"),
    ("cc-by", 2, r"this (?:work|article|document|image) is licensed under a creative commons attribution"),
    ("cc-by-4.0", 4, r"creative commons attribution 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc-by-3.0", 4, r"creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?"),
    ("cc-by-sa-4.0", 4, r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-sa-3.0", 4, r"creative commons attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-nc-4.0", 4, r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("reserved", 1, r"(?:some|no) rights reserved"),
    ("proprietary", 2, r"confidential and proprietary"),
    ("proprietary", 2, r"(?:commercial|proprietary) licen[sc]e(?: agreement)?"),
    ("proprietary", 2, r"contains (?:trade secrets|proprietary information)"),
    ("proprietary", 1, r"may not be (?:copied|reproduced|redistributed|published) (?:in whole or in part )?without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", 1, r"reproduced (?:only )?with (?:the )?(?:kind )?permission of"),
    ("proprietary", 1, r"unpublished (?:proprietary )?(?:work|source code) all rights reserved"),
    ("eula", 3, r"end user licen[sc]e agreement"),
    ("shareware", 2, r"(?:shareware|freeware|evaluation) licen[sc]e"),
    ("dual", 2, r"dual licen[sc]ed under"),
    ("licence-file", 1, r"(?:licensed|licenced|released|distributed) under the (?:same )?terms (?:and conditions )?of the licen[sc]e"),
    ("licence-file", 1, r"subject to the (?:terms|conditions) of (?:the|this) licen[sc]e"),
    ("copyright", 1, r"(?:copyright|copyrights|copr) (?:19|20)[0-9]{2} (?:by )?the (?:authors?|contributors?|copyright holders?)"),
    ("trademark", 1, r"registered trademark (?:of|and copyright)"),
    ("warranty", 1, r"(?:disclaimer of|no) warrant(?:y|ies)"),
    ("copyright", 1, r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", 1, r"copyright c"),
    ("warranty", 1, r"without warrant(?:y|ies) of any kind"),
    ("licence-file", 1, r"see the licen[sc]e(?: file)? for"),
)
#: Families of identifiers and versions; the rules of a family follow from these.
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
SPDX = ("0bsd", "afl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "cddl-1.0", "cecill-2.1", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2", "gfdl-1.3", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "lppl-1.3c", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ncsa", "odbl-1.0", "ofl-1.1", "osl-3.0", "postgresql", "python-2.0", "ruby", "sleepycat", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "zlib", "zpl-2.1")


def _words(text: str) -> str:
    return text.replace("-", " ").replace(".", " ")


def rules() -> list[tuple[str, int, str, bool]]:
    """All rules in order: label, priority, regular expression, whether it is a base rule."""
    out = [(label, 2, phrase, True) for phrase, label in BASE]
    out += [(label, p, rule, False) for label, p, rule in WRITTEN]
    for kind in CC_KINDS:
        out.append((f"cc-{kind}", 3, f"cc {_words(kind)}", False))
        for v in CC_VERSIONS:
            out.append((f"cc-{kind}-{v}", 4, f"cc {_words(kind)} {_words(v)}(?: international| unported| generic)?", False))
    for name in SPDX:
        out.append((name, 5, f"spdx license identifier {_words(name)}", False))
        out.append((name + "-or-later", 5, f"spdx license identifier {_words(name)} or later", False))
        out.append((name, 2, f"under the {_words(name)} licen[sc]e", False))
        out.append((name, 2, f"license {_words(name)}", False))
    return out


def keywords(rule: str) -> list[str]:
    """The words that a match can begin with."""
    if rule.startswith("(?:"):
        return sorted({x.split(" ")[0] for x in rule[3 : rule.index(")")].split("|")})
    first = rule.split(" ")[0]
    if first == "gplv?[123]":
        return [f"gpl{v}{n}" for v in ("", "v") for n in "123"]
    name = first.split("(")[0]
    if rule.startswith(name + _V):
        # the version may be joined to the name
        return [name, name + rule[len(name + _V)]]
    if first.startswith("cc0"):
        return ["cc0"]
    if first.startswith("unauthori"):
        return ["unauthorised", "unauthorized"]
    return [first]


def longest(rule: str) -> int:
    """Most words that a match can have: no rule repeats a space, so one more than it has spaces; at times too many where it has alternatives."""
    return 1 + rule.count(" ")


#: Strings of which a text must hold one to hold any signature; cc and by must stand apart from each other by a gap.
GATES = ("licen", "gpl", "reserved", "copyright", "copr", "commons", "domain", "redistribution", "permission", "proprietary", "unauthori", "warrant", "spdx", "mpl", "neither", "unencumbered", "cc0", "clause", "bsd", "attribution", "advertising", "altered", "exception", "linux", "trade", "persons")
GATE_CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() would also turn two letters into ASCII ones."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document; see above."""
    table = rules()
    by_word: dict[str, list[int]] = {}
    for i, (_, _, rule, _) in enumerate(table):
        for w in keywords(rule):
            by_word.setdefault(w, []).append(i)
    anchors = "(" + ", ".join(map(_sql_text, sorted(by_word))) + ")"
    number = "map(" + ", ".join(f"{_sql_text(w)}, array({', '.join(map(str, ids))})" for w, ids in sorted(by_word.items())) + ")"
    reach_of = "map(" + ", ".join(f"{_sql_text(w)}, {max(longest(table[i][2]) for i in ids)}" for w, ids in sorted(by_word.items())) + ")"
    listed = "array(" + ", ".join(f"named_struct('label', {_sql_text(label)}, 'priority', {p}, 'rule', {_sql_text('^(?:' + rule + ')(?= |$)')}, 'base', {str(base).lower()})" for label, p, rule, base in table) + ")"

    low = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("_low"))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.col("_low").contains(g)
    gate = gate | (F.col("_low").contains("cc") & F.col("_low").rlike(GATE_CC))
    # one letter for each word with the gaps around it; a text without words keeps its gap characters
    marked = F.regexp_replace("_low", f"(?:{GAP})?{WORD}(?:{GAP})?", "x")
    gated = low.select(
        "doc_id",
        F.when(marked.startswith("x"), F.length(marked)).otherwise(0).cast("long").alias("n_words"),
        F.when(gate, F.expr(f"filter(split(regexp_replace(_low, {_sql_text(GAP)}, ' '), ' '), x -> x <> '')")).otherwise(F.expr("cast(array() as array<string>)")).alias("_words"),
    )
    placed = gated.withColumn("_at", F.expr(f"filter(transform(_words, (w, i) -> if(w in {anchors}, i, -1)), i -> i >= 0)"))
    found = placed.select(
        "doc_id",
        "n_words",
        F.expr(
            f"""flatten(transform(_at, i -> transform(
                  array(array_join(slice(_words, i + 1, element_at({reach_of}, element_at(_words, i + 1))), ' ')),
                  near -> filter(transform(element_at({number}, element_at(_words, i + 1)),
                    k -> named_struct('start', i,
                                      'size', regexp_count(regexp_extract(near, element_at({listed}, k + 1).rule, 0), '[^ ]+'),
                                      'priority', element_at({listed}, k + 1).priority,
                                      'label', element_at({listed}, k + 1).label,
                                      'base', element_at({listed}, k + 1).base)),
                    m -> m.size > 0))[0]))"""
        ).alias("_found"),
    )
    # sorted by start, then longest, then highest priority; the fold keeps, for each priority, the furthest end of an interval of at least that priority
    ordered = found.withColumn("_sorted", F.expr("array_sort(transform(_found, m -> named_struct('start', m.start, 'less', -m.size, 'low', -m.priority, 'label', m.label, 'base', m.base)))"))
    reach = f"array_repeat(-1, {TOP})"
    folded = ordered.withColumn(
        "_kept",
        F.expr(
            f"""aggregate(_sorted, named_struct('far', {reach}, 'labels', cast(array() as array<string>), 'n', 0L, 'top', 0),
                (s, m) -> named_struct(
                  'far', transform(s.far, (e, p) -> if(p < -m.low, greatest(e, m.start - m.less), e)),
                  'labels', if(m.base or element_at(s.far, -m.low) < m.start - m.less, array_union(s.labels, array(m.label)), s.labels),
                  'n', s.n + if(m.base or element_at(s.far, -m.low) < m.start - m.less, 1L, 0L),
                  'top', greatest(s.top, -m.low)))"""
        ),
    ).withColumn("_base", F.expr("filter(_found, m -> m.base)"))
    return folded.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(_base, m -> m.start)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(_base, m -> m.start)) as bigint)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(_base, m -> m.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(_kept.labels), ',')").alias("labels"),
        (F.col("_kept.top") / TOP).alias("score"),
        F.col("_kept.n").alias("n_matches"),
    )
