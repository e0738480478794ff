"""License scans by ordered signature rules.

A text becomes its words, A-Z in lower case, one blank between them. Each rule is a regular
expression over that string with a label, a priority and keywords (some joined by +, which must stand
together) one of which the words must hold before the expression is tried. Every text that
an expression matches holds one of its keywords, so gates save time and lose nothing. Matches are resolved in the order of their
priority, then length, then place: one that lies inside an accepted match is suppressed,
unless it is a base phrase, which always counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Names of licenses, as expressions over words, with the keywords that gate them. A name
#: alone says little; the templates below say in which company it counts.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)"),
    ("apache-2", "apache apache2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 0"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd bsd", r"(?:0bsd|zero clause bsd)"),
    ("gpl-2", "gpl gplv2 gpl2 general+public", r"(?:gnu )?(?:gplv2|gpl2|gpl(?: version| v)? ?2(?: 0)?|general public license(?: version| v)? ?2(?: 0)?)"),
    ("gpl-3", "gpl gplv3 gpl3 general+public", r"(?:gnu )?(?:gplv3|gpl3|gpl(?: version| v)? ?3(?: 0)?|general public license(?: version| v)? ?3(?: 0)?)"),
    ("lgpl-2.1", "lgpl lgplv2 lgpl2 lesser", r"(?:gnu )?(?:lgplv2 1|lgpl(?: version| v)? ?2 1|lesser general public license(?: version| v)? ?2 1)"),
    ("lgpl-3", "lgpl lgplv3 lgpl3 lesser", r"(?:gnu )?(?:lgplv3|lgpl(?: version| v)? ?3(?: 0)?|lesser general public license(?: version| v)? ?3(?: 0)?)"),
    ("agpl-3", "agpl agplv3 agpl3 affero", r"(?:gnu )?(?:agplv3|agpl(?: version| v)? ?3(?: 0)?|affero general public license(?: version| v)? ?3(?: 0)?)"),
    ("mpl-1.1", "mpl mpl1 mozilla", r"(?:mpl(?: version| v)? ?1 1|mozilla public license(?: version| v)? ?1 1)"),
    ("mpl-2", "mpl mpl2 mozilla", r"(?:mpl(?: version| v)? ?2(?: 0)?|mozilla public license(?: version| v)? ?2(?: 0)?)"),
    ("epl-1", "epl epl1 eclipse", r"(?:epl(?: version| v)? ?1(?: 0)?|eclipse public license(?: version| v)? ?1(?: 0)?)"),
    ("epl-2", "epl epl2 eclipse", r"(?:epl(?: version| v)? ?2(?: 0)?|eclipse public license(?: version| v)? ?2(?: 0)?)"),
    ("cddl-1", "cddl cddl1 development+distribution", r"(?:cddl(?: version| v)? ?1(?: [01])?|common development and distribution license)"),
    ("eupl-1.2", "eupl eupl1 european+union", r"(?:eupl(?: version| v)? ?1 2|european union public licence(?: version| v)? ?1 2)"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-1", "artistic artistic1", r"artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic artistic2", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2", "python psf python2 psf2", r"(?:python software foundation|psf|python)(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php php3", r"php(?: license)?(?: version| v)? ?3(?: 01| 0)?"),
    ("openssl", "openssl", r"openssl"),
    ("ofl-1.1", "ofl ofl1 sil", r"(?:ofl(?: version| v)? ?1 1|sil open font license(?: version| v)? ?1 1)"),
    ("ms-pl", "microsoft pl", r"(?:ms pl|microsoft public license)"),
    ("ms-rl", "microsoft rl", r"(?:ms rl|microsoft reciprocal license)"),
    ("upl-1", "upl upl1 universal+permissive", r"(?:upl(?: version| v)? ?1(?: 0)?|universal permissive license)"),
    ("ncsa", "ncsa", r"(?:ncsa|university of illinois ncsa)"),
    ("afl-3", "academic afl afl3", r"(?:afl(?: version| v)? ?3(?: 0)?|academic free license(?: version| v)? ?3(?: 0)?)"),
    ("osl-3", "osl osl3 open+software", r"(?:osl(?: version| v)? ?3(?: 0)?|open software license(?: version| v)? ?3(?: 0)?)"),
    ("cc0", "cc0 creative", r"(?:cc0(?: 1 0)?|creative commons zero(?: v?1(?: 0)?)?)"),
    ("cc-by", "by attribution", r"(?:cc by|creative commons attribution)(?! nc| sa| nd| share| non| no)(?: (?P<v>[1-4]) [05])?"),
    ("cc-by-sa", "sa share sharealike", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nd", "nd noderivs noderivatives derivs derivatives", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc", "nc noncommercial non+commercial", r"(?:cc by nc|creative commons attribution non ?commercial)(?! sa| nd| share| no)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "nc noncommercial non+commercial", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "nc noncommercial non+commercial", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("gfdl", "gfdl gfdl1 documentation", r"(?:gfdl|gnu free documentation license)(?:(?: version| v)? ?1 [123])?"),
    ("odbl", "odbl database", r"(?:odbl|open database license)(?: v?1(?: 0)?)?"),
    ("odc-by", "odc commons+attribution", r"(?:odc by|open data commons attribution(?: license)?)"),
    ("pddl", "pddl commons+dedication", r"(?:pddl|open data commons public domain dedication)"),
    ("cdla-permissive", "cdla community+data", r"(?:cdla permissive|community data license agreement permissive)"),
    ("cdla-sharing", "cdla community+data", r"(?:cdla sharing|community data license agreement sharing)"),
    ("openrail", "openrail rail", r"(?:creativeml )?open ?rail(?: m| s)?(?: license)?"),
    ("llama-2", "llama", r"llama 2 community"),
    ("llama-3", "llama", r"llama 3(?: [123])? community"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("busl-1.1", "busl business", r"(?:busl 1 1|business source license(?: 1 1)?)"),
    ("sspl-1", "sspl server+side", r"(?:sspl(?: v?1)?|server side public license)"),
    ("elastic-2", "elastic", r"elastic license(?: 2(?: 0)?)?"),
    ("commons-clause", "commons", r"commons clause"),
    ("polyform-nc", "polyform", r"polyform non ?commercial"),
)

#: (name of the template, priority, expression around a name, share of certainty)
TEMPLATES = (
    ("identifier", 10, r"spdx license identifier %s(?: or later| only| plus)?", 1.0),
    ("grant", 20, r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|dual licen[cs]ed) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?%s(?: international| public)?(?: licen[cs]e)?(?: version [0-9](?: [0-9])?)?", 0.95),
    ("terms", 30, r"(?:under|subject to|in accordance with) (?:the )?terms (?:and conditions )?of (?:the )?%s(?: licen[cs]e)?", 0.9),
    ("field", 40, r"licen[cs]e (?:is |type |name |id )?%s(?: licen[cs]e)?", 0.7),
    ("named", 50, r"(?:the )?%s licen[cs]e(?: agreement)?", 0.6),
)

#: Sentences of license texts, notices, headers and addresses: (label, priority, keywords, expression, certainty).
SENTENCES: tuple[tuple[str, int, str, str, float], ...] = (
    ("mit", 5, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", 6, "notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("isc", 5, "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 1.0),
    ("0bsd", 4, "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 1.0),
    ("bsd", 5, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that", 0.95),
    ("bsd-3-clause", 6, "endorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", 6, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("apache-2", 5, "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.95),
    ("apache-2", 5, "apache", r"www apache org licenses license 2 0", 1.0),
    ("apache-2", 6, "basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.9),
    ("gpl", 5, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 1.0),
    ("gpl-2", 4, "gnu", r"gnu general public license as published by the free software foundation either version 2 of the license", 1.0),
    ("gpl-3", 4, "gnu", r"gnu general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("lgpl-2.1", 4, "lesser", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 1.0),
    ("lgpl-3", 4, "lesser", r"gnu lesser general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("agpl-3", 4, "affero", r"gnu affero general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("gpl", 7, "gnu", r"you should have received a copy of the gnu general public license along with", 0.95),
    ("lgpl", 7, "lesser", r"you should have received a copy of the gnu lesser general public license along with", 0.95),
    ("agpl", 7, "affero", r"you should have received a copy of the gnu affero general public license along with", 0.95),
    ("mpl-2", 5, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", 6, "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", 5, "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1", 5, "eclipse", r"made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2", 5, "eclipse", r"made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("cddl-1", 5, "development+distribution", r"subject to the terms of the common development and distribution license", 1.0),
    ("bsl-1", 5, "boost", r"distributed under the boost software license version 1 0", 1.0),
    ("zlib", 5, "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", 6, "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented", 1.0),
    ("unlicense", 5, "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", 30, "domain", r"(?:released into|dedicated to|placed in(?:to)?) the public domain", 0.8),
    ("public-domain", 45, "domain", r"(?:this work|this file|this document|it) is in the public domain", 0.8),
    ("cc0", 20, "waived", r"has waived all copyright and related or neighboring rights", 0.9),
    ("wtfpl", 5, "fuck", r"do what the fuck you want to public license", 1.0),
    ("artistic-2", 5, "artistic", r"the artistic license 2 0", 1.0),
    ("ofl-1.1", 5, "font", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("postgresql", 6, "paragraph", r"without a written agreement is hereby granted provided that the above copyright notice and this paragraph", 0.8),
    ("openssl", 6, "openssl", r"this product includes software developed by the openssl project", 1.0),
    ("gfdl", 5, "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("cc-by", 6, "creativecommons", r"creativecommons org licenses by [1-4] [05]", 1.0),
    ("cc-by-sa", 6, "creativecommons", r"creativecommons org licenses by sa [1-4] [05]", 1.0),
    ("cc-by-nd", 6, "creativecommons", r"creativecommons org licenses by nd [1-4] [05]", 1.0),
    ("cc-by-nc", 6, "creativecommons", r"creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nc-sa", 6, "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", 6, "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    ("cc0", 6, "creativecommons", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("llama-2", 6, "llama", r"llama 2 is licensed under the llama 2 community license", 1.0),
    ("sspl-1", 6, "server+side", r"server side public license version 1 as published by mongodb", 1.0),
    ("commons-clause", 6, "licensor", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", 0.9),
    # permissive: the MIT family
    ("mit", 6, "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0),
    ("mit", 6, "furnished", r"to permit persons to whom the software is furnished to do so subject to the following conditions", 1.0),
    ("mit-0", 5, "furnished", r"to permit persons to whom the software is furnished to do so the software is provided as is", 1.0),
    ("mit", 7, "noninfringement", r"the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders", 0.9),
    ("mit", 20, "expat", r"expat licen[cs]e", 0.9),
    ("mit", 25, "mit", r"mit (?:style|type|like|x11) licen[cs]e", 0.7),
    ("x11", 6, "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 1.0),
    ("hpnd", 5, "hereby", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted", 0.9),
    ("hpnd", 6, "supporting", r"both that copyright notice and this permission notice appear in supporting documentation", 0.9),
    ("json", 5, "evil", r"the software shall be used for good not evil", 1.0),
    ("beerware", 5, "beer", r"you can buy me a beer in return", 1.0),
    ("beerware", 5, "beer beerware", r"the beer ?ware license", 1.0),
    ("isc", 6, "disclaims", r"the software is provided as is and (?:the author|isc|[^ ]+(?: [^ ]+){0,5}) disclaims all warranties with regard to this software", 0.9),
    ("isc", 7, "tortious", r"resulting from loss of use data or profits whether in an action of contract negligence or other tortious action", 0.8),
    ("tcl", 5, "authors", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 1.0),
    ("bsl-1", 6, "organization", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("curl", 6, "curl", r"the curl license", 0.9),
    ("blueoak-1", 5, "oak", r"blue oak model license", 1.0),
    ("mulan-2", 5, "mulan", r"mulan (?:psl v2|permissive software license)", 1.0),
    # permissive: the BSD family
    ("bsd", 6, "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", 6, "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", 0.95),
    ("bsd", 7, "contributors", r"this software is provided by the (?:copyright holders|regents|author) and contributors as is and any express or implied warranties", 0.9),
    ("bsd-4-clause", 5, "berkeley", r"this product includes software developed by the university of california berkeley and its contributors", 1.0),
    ("bsd-3-clause-clear", 5, "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 1.0),
    ("bsd-2-clause-patent", 5, "holder", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license", 1.0),
    ("bsd-3-clause-no-nuclear", 5, "nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 1.0),
    ("bsd", 25, "bsd", r"bsd (?:style|type|like) licen[cs]e", 0.7),
    ("bsd-2-clause", 30, "clause", r"(?:two|2) clause bsd", 0.8),
    ("bsd-3-clause", 30, "clause", r"(?:three|3) clause bsd", 0.8),
    ("bsd-4-clause", 30, "clause", r"(?:four|4) clause bsd", 0.8),
    ("ncsa", 5, "illinois", r"university of illinois ncsa open source license", 1.0),
    ("edl-1", 5, "eclipse", r"eclipse distribution license (?:v )?1 0", 1.0),
    ("zpl-2", 5, "zope", r"zope public license(?: zpl)?(?: version)? 2 [01]", 1.0),
    ("w3c", 5, "w3c", r"w3c software (?:notice and license|and document notice and license)", 1.0),
    ("xfree86", 6, "xfree86", r"this product includes software developed by the xfree86 project", 1.0),
    ("sleepycat", 5, "sleepycat", r"(?:the )?sleepycat (?:public )?license", 1.0),
    ("sleepycat", 6, "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("openssl", 5, "cryptographic", r"this product includes cryptographic software written by eric young", 1.0),
    ("ijg", 5, "jpeg", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", 5, "freetype", r"portions of this software are copyright .{1,40}? the freetype project", 1.0),
    ("libpng", 6, "png", r"the png reference library is supplied as is", 1.0),
    ("zlib", 6, "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("imagemagick", 5, "imagemagick", r"imagemagick license", 1.0),
    ("unicode", 5, "unicode", r"unicode (?:inc )?license agreement", 1.0),
    ("icu", 20, "icu", r"icu license", 0.8),
    ("vim", 5, "vim", r"(?:the )?vim license", 0.9),
    ("psf-2", 5, "psf", r"psf license agreement for python [23](?: [0-9]+)*", 1.0),
    ("cnri-python", 5, "cnri", r"cnri (?:open source )?license agreement", 1.0),
    ("postgresql", 7, "postgresql", r"postgresql database management system formerly known as postgres", 0.9),
    # Apache
    ("apache-2", 6, "appendix", r"appendix how to apply the apache license to your work", 1.0),
    ("apache-2", 5, "apache", r"licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2", 6, "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 1.0),
    ("apache-2", 7, "individual", r"contributor shall mean licensor and any individual or legal entity on behalf of whom", 1.0),
    ("apache-2", 8, "governing", r"see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-2", 6, "foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-1.1", 6, "foundation", r"this product includes software developed by the apache software foundation", 0.8),
    ("apache-1", 6, "apache", r"this product includes software developed by the apache group", 1.0),
    ("apache-2", 25, "asl", r"asl 2 0", 0.7),
    ("apache-2", 30, "apache", r"apache 2 0 licen[cs]ed", 0.8),
    ("ecl-2", 5, "educational", r"educational community license (?:version |v )?2 0", 1.0),
    # copyleft: the GNU family
    ("gpl-1", 5, "february", r"gnu general public license version 1 february 1989", 1.0),
    ("gpl-2", 5, "june", r"gnu general public license version 2 june 1991", 1.0),
    ("gpl-3", 5, "june", r"gnu general public license version 3 29 june 2007", 1.0),
    ("lgpl-2", 5, "library", r"gnu library general public license", 1.0),
    ("lgpl-2.1", 5, "february", r"gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-3", 5, "june", r"gnu lesser general public license version 3 29 june 2007", 1.0),
    ("agpl-3", 5, "november", r"gnu affero general public license version 3 19 november 2007", 1.0),
    ("gpl", 6, "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 0.95),
    ("gpl-3", 6, "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl-3", 6, "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl", 6, "remotely", r"all users interacting with it remotely through a computer network", 0.9),
    ("gpl", 8, "hope", r"this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("lgpl", 8, "hope", r"this library is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl-2", 6, "option", r"either version 2 of the license or at your option any later version", 0.9),
    ("gpl-3", 6, "option", r"either version 3 of the license or at your option any later version", 0.9),
    ("lgpl-2.1", 6, "option", r"either version 2 1 of the license or at your option any later version", 0.9),
    ("gpl-2", 5, "gnu", r"under the terms of version 2 of the gnu general public license", 1.0),
    ("gpl-3", 5, "gnu", r"under the terms of version 3 of the gnu general public license", 1.0),
    ("lgpl-2.1", 5, "lesser", r"under the terms of version 2 1 of the gnu lesser general public license", 1.0),
    ("lgpl-3", 5, "lesser", r"under the terms of version 3 of the gnu lesser general public license", 1.0),
    ("agpl-3", 5, "affero", r"under the terms of version 3 of the gnu affero general public license", 1.0),
    ("gpl", 9, "foundation", r"write to the free software foundation inc (?:59 temple place|51 franklin st(?:reet)?|675 mass ave)", 0.8),
    ("gpl", 9, "gnu", r"gnu org licenses (?:old licenses )?gpl", 0.8),
    ("lgpl", 9, "gnu", r"gnu org licenses (?:old licenses )?lgpl", 0.8),
    ("agpl", 9, "gnu", r"gnu org licenses agpl", 0.8),
    ("gfdl", 9, "gnu", r"gnu org licenses fdl", 0.8),
    ("gpl", 9, "gnu", r"along with this program if not see https? www gnu org licenses", 0.9),
    ("classpath-exception", 5, "classpath", r"classpath exception", 1.0),
    ("classpath-exception", 6, "statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 1.0),
    ("gcc-exception", 5, "gcc", r"gcc runtime library exception", 1.0),
    ("autoconf-exception", 5, "autoconf", r"configuration script generated by autoconf", 1.0),
    ("bison-exception", 5, "bison", r"contains (?:part or all of )?the bison parser skeleton", 1.0),
    ("openssl-exception", 6, "openssl", r"permission to link (?:the code of )?(?:portions of )?this program with the openssl library", 1.0),
    ("linux-syscall-note", 5, "kernel", r"this copyright does not cover user programs that use kernel services by normal system calls", 1.0),
    ("gfdl", 6, "invariant", r"with no invariant sections no front cover texts and no back cover texts", 1.0),
    # copyleft of files and others
    ("mpl-1", 5, "mozilla", r"subject to the mozilla public license version 1 0", 1.0),
    ("npl-1.1", 5, "netscape", r"subject to the netscape public license version 1 [01]", 1.0),
    ("mpl-2", 6, "secondary", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", 1.0),
    ("mpl-1.1", 7, "governing", r"see the license for the specific language governing rights and limitations under the license", 0.8),
    ("mpl-2", 8, "mozilla", r"mozilla org (?:en us )?mpl 2 0", 1.0),
    ("mpl-1.1", 8, "mozilla", r"mozilla org (?:en us )?mpl (?:mpl )?1 1", 1.0),
    ("cpl-1", 5, "common", r"common public license (?:version |v )?1 0", 1.0),
    ("ipl-1", 5, "ibm", r"ibm public license (?:version |v )?1 0", 1.0),
    ("epl-1", 8, "eclipse", r"eclipse org legal epl v10", 1.0),
    ("epl-2", 8, "eclipse", r"eclipse org legal epl (?:v20|2 0)", 1.0),
    ("epl", 7, "acceptance", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", 0.9),
    ("cddl-1", 6, "cddl", r"cddl header start", 1.0),
    ("cddl-1.1", 5, "cddl", r"cddl (?:version |v )?1 1", 1.0),
    ("apsl-2", 5, "apple", r"apple public source license", 1.0),
    ("qpl-1", 5, "q+public", r"q public license (?:version )?1 0", 1.0),
    ("osl-3", 6, "osl", r"licensed under the open software license (?:osl )?v?(?:ersion )?3 0 osl", 0.9),
    ("rpl-1.5", 5, "reciprocal", r"reciprocal public license(?: 1 5)?", 1.0),
    ("cecill-2.1", 5, "cecill", r"cecill (?:free software license agreement )?(?:version |v )?2 1", 1.0),
    ("cecill-b", 5, "cecill", r"cecill b", 1.0),
    ("cecill-c", 5, "cecill", r"cecill c", 1.0),
    ("eupl-1.1", 5, "eupl", r"eupl (?:version |v ?)?1 1", 1.0),
    ("eupl", 25, "eupl", r"licensed under the eupl", 0.8),
    ("lppl-1.3", 5, "latex", r"latex project public license", 1.0),
    ("perl", 5, "perl", r"under the same terms as perl(?: itself)?", 1.0),
    ("artistic-1", 6, "artistic", r"the clarified artistic license", 0.9),
    ("wxwindows", 5, "wxwindows", r"wxwindows library licen[cs]e", 1.0),
    ("nasa-1.3", 5, "nasa", r"nasa open source agreement", 1.0),
    ("watcom-1", 5, "watcom", r"sybase open watcom public license", 1.0),
    ("gsoap-1.3", 5, "gsoap", r"gsoap public license", 1.0),
    ("sgi-b-2", 5, "sgi", r"sgi free software license b", 1.0),
    ("zend-2", 5, "zend", r"zend engine license", 1.0),
    # addresses of license texts
    ("mit", 9, "opensource", r"opensource org licenses mit", 1.0),
    ("bsd-2-clause", 9, "opensource", r"opensource org licenses bsd 2 clause", 1.0),
    ("bsd-3-clause", 9, "opensource", r"opensource org licenses bsd 3 clause", 1.0),
    ("apache-2", 9, "opensource", r"opensource org licenses apache 2 0", 1.0),
    ("gpl-2", 9, "opensource", r"opensource org licenses gpl 2 0", 1.0),
    ("gpl-3", 9, "opensource", r"opensource org licenses gpl 3 0", 1.0),
    ("isc", 9, "opensource", r"opensource org licenses isc", 1.0),
    ("cddl-1", 9, "opensource", r"opensource org licenses cddl", 1.0),
    ("afl-3", 9, "opensource", r"opensource org licenses afl 3 0", 1.0),
    ("osl-3", 9, "opensource", r"opensource org licenses osl 3 0", 1.0),
    ("mit", 9, "choosealicense", r"choosealicense com licenses mit", 1.0),
    ("apache-2", 9, "choosealicense", r"choosealicense com licenses apache 2 0", 1.0),
    ("gpl-3", 9, "choosealicense", r"choosealicense com licenses gpl 3 0", 1.0),
    ("unlicense", 9, "unlicense", r"unlicense org", 1.0),
    ("wtfpl", 9, "wtfpl", r"wtfpl net", 1.0),
    ("ofl-1.1", 9, "sil", r"scripts sil org ofl", 1.0),
    ("odbl", 9, "opendatacommons", r"opendatacommons org licenses odbl", 1.0),
    ("pddl", 9, "opendatacommons", r"opendatacommons org licenses pddl", 1.0),
    ("odc-by", 9, "opendatacommons", r"opendatacommons org licenses by", 1.0),
    # Creative Commons and the public domain
    ("cc-by", 6, "attribution", r"creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc-by-sa", 6, "sharealike", r"creative commons attribution sharealike (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc-by-nd", 6, "noderivs noderivatives", r"creative commons attribution (?:noderivs|noderivatives) (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc-by-nc", 6, "noncommercial", r"creative commons attribution noncommercial (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc-by-nc-sa", 6, "sharealike", r"creative commons attribution noncommercial sharealike (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc-by-nc-nd", 6, "noderivs noderivatives", r"creative commons attribution noncommercial (?:noderivs|noderivatives) (?:[1-4] [05] )?(?:international|unported|generic)", 1.0),
    ("cc", 20, "sublicensable", r"a worldwide royalty free non sublicensable non exclusive irrevocable license to exercise the licensed rights", 0.9),
    ("cc", 50, "reserved", r"some rights reserved", 0.4),
    ("cc0", 6, "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 1.0),
    ("cc-pdm", 6, "creativecommons", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("unlicense", 6, "relinquishment", r"overt act of relinquishment in perpetuity of all present and future rights", 1.0),
    ("public-domain", 20, "dedicate", r"(?:we|i) (?:hereby )?dedicate (?:this|the) (?:software|work|code|document) to the public domain", 0.9),
    ("public-domain", 20, "government", r"(?:is )?a work of the (?:u s|united states) government", 0.8),
    ("public-domain", 20, "protection", r"not subject to copyright protection in the united states", 0.9),
    ("public-domain", 25, "disclaims", r"the author disclaims copyright to this source code", 0.9),
    # data, documents, fonts
    ("odbl", 6, "database", r"made available (?:here )?under the open database license", 1.0),
    ("ogl-uk-3", 5, "government", r"open government licen[cs]e v3 0", 1.0),
    ("ogl-uk", 6, "sector", r"contains public sector information licensed under the open government licen[cs]e", 1.0),
    ("ogl-canada", 5, "canada", r"open government licen[cs]e canada", 1.0),
    ("etalab-2", 5, "ouverte", r"licence ouverte(?: etalab)?(?: 2 0)?", 0.9),
    ("dl-de-by-2", 5, "datenlizenz", r"datenlizenz deutschland namensnennung (?:version )?2 0", 1.0),
    ("dl-de-zero-2", 5, "datenlizenz", r"datenlizenz deutschland zero (?:version )?2 0", 1.0),
    ("gutenberg", 5, "gutenberg", r"(?:full )?project gutenberg (?:tm )?license", 1.0),
    ("free-art-1.3", 5, "art", r"(?:free art license|licence art libre) 1 3", 1.0),
    ("opl-1", 5, "publication", r"open publication license v?1 0", 1.0),
    ("ofl-1.1", 6, "fonts", r"the fonts and derivatives however cannot be released under any other type of license", 1.0),
    ("ofl-1.1", 8, "font", r"with reserved font name", 0.8),
    ("ubuntu-font-1", 5, "ubuntu", r"ubuntu font licen[cs]e (?:version )?1 0", 1.0),
    ("bitstream-vera", 5, "vera", r"bitstream vera is a trademark of bitstream", 1.0),
    # models
    ("openrail", 6, "restrictions", r"use based restrictions as referenced in paragraph 5", 1.0),
    ("bigscience-rail", 5, "bigscience", r"bigscience (?:bloom |open )?rail(?: m)? license", 1.0),
    ("openrail", 25, "responsible", r"responsible ai license", 0.8),
    ("llama", 6, "million", r"greater than 700 million monthly active users", 0.9),
    ("llama-3", 6, "llama", r"built with (?:meta )?llama 3", 0.9),
    ("gemma", 6, "gemma", r"gemma is provided under and subject to the gemma terms of use", 1.0),
    ("falcon", 5, "falcon", r"falcon (?:[0-9]+b )?(?:tii )?(?:llm )?license", 1.0),
    ("ai2-impact", 5, "ai2", r"ai2 impact license", 1.0),
    ("deepseek", 5, "deepseek", r"deepseek (?:model )?license(?: agreement)?", 1.0),
    ("qwen", 5, "qianwen", r"tongyi qianwen (?:research )?license agreement", 1.0),
    ("mistral-research", 5, "mistral", r"mistral (?:ai )?(?:research|non production) license", 1.0),
    ("stability-community", 5, "stability", r"stability ai (?:non commercial research )?community license", 1.0),
    ("nvidia-open-model", 5, "nvidia", r"nvidia open model license", 1.0),
    # source that may be read but not used freely
    ("busl-1.1", 6, "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("elastic-2", 6, "hosted", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("sspl-1", 6, "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("commons-clause", 6, "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 1.0),
    ("polyform-small-business", 5, "polyform", r"polyform small business", 1.0),
    ("polyform-shield", 5, "polyform", r"polyform shield", 1.0),
    ("polyform-strict", 5, "polyform", r"polyform strict", 1.0),
    ("polyform-internal-use", 5, "polyform", r"polyform internal use", 1.0),
    ("confluent-community", 5, "confluent", r"confluent community license", 1.0),
    ("redis-sal", 5, "redis", r"redis source available license", 1.0),
    ("timescale", 5, "timescale", r"timescale license", 1.0),
    ("fsl", 5, "functional", r"functional source license", 1.0),
    ("parity", 5, "parity", r"parity public license", 1.0),
    ("prosperity", 5, "prosperity", r"prosperity public license", 1.0),
    ("hippocratic", 5, "hippocratic", r"hippocratic license", 1.0),
    ("anti-996", 5, "996", r"anti 996 license", 1.0),
    ("cockroach-community", 5, "cockroachdb", r"cockroachdb community license", 1.0),
    ("oracle-bcl", 5, "binary", r"(?:oracle|sun microsystems inc) binary code license agreement", 1.0),
    ("oracle-technology", 5, "oracle", r"oracle technology network license agreement", 1.0),
    ("ms-eula", 20, "microsoft", r"microsoft software license terms", 0.9),
    # reservations
    ("proprietary", 35, "nondisclosure non+disclosure", r"subject to (?:the terms of )?a non ?disclosure agreement", 0.8),
    ("proprietary", 35, "trade", r"(?:contains|constitutes) (?:confidential )?trade secrets", 0.7),
    ("proprietary", 35, "end+user", r"end user licen[cs]e agreement", 0.7),
    ("proprietary", 40, "permission", r"(?:may|must) not be (?:copied|reproduced|redistributed|distributed) (?:or distributed )?without (?:the )?(?:prior |express )?(?:written )?permission", 0.7),
    ("proprietary", 45, "internal", r"for internal use only", 0.4),
    ("evaluation", 35, "evaluation", r"for evaluation (?:use|purposes) only", 0.7),
    ("non-commercial", 30, "noncommercial non+commercial", r"for (?:personal )?non ?commercial (?:use|purposes) only", 0.7),
    ("research-only", 30, "research", r"for (?:academic |non commercial )?research (?:use|purposes) only", 0.7),
    ("educational-only", 30, "educational", r"for educational (?:use|purposes) only", 0.6),
    ("freeware", 40, "freeware", r"this (?:software|program) is freeware", 0.6),
    ("shareware", 40, "shareware", r"this (?:software|program) is shareware", 0.6),
    ("proprietary", 40, "reserved", r"all rights reserved", 0.5),
    ("proprietary", 35, "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", 35, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of|or) .{1,80}? (?:is )?(?:strictly )?prohibited", 0.8),
    ("all-permissive", 6, "medium", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("gpl", 55, "gpl", r"gpl", 0.4),
    ("lgpl", 55, "lgpl", r"lgpl", 0.4),
    ("agpl", 55, "agpl", r"agpl", 0.4),
    ("copyleft", 60, "copyleft", r"copyleft", 0.3),
    ("unknown-license", 70, "license", r"licensed under (?:a |an |the )?(?:[^ ]+ ){0,4}license", 0.3),
)


class Rule:
    __slots__ = ("label", "name", "priority", "certainty", "keywords", "find", "base")

    def __init__(self, label: str, name: str, priority: int, certainty: float, keywords: frozenset[frozenset[bytes]], pattern: str, base: bool = False):
        self.label, self.name, self.priority, self.certainty, self.keywords, self.base = label, name, priority, certainty, keywords, base
        # whole words; a lookahead lets base phrases overlap themselves
        body = f" (?=({pattern}) )" if base else f"(?<= )(?:{pattern})(?= )"
        self.find = re.compile(body.encode()).finditer


def rules() -> list[Rule]:
    """All rules, in the order of their priority: base phrases, names in each template, sentences."""
    words = lambda s: frozenset(frozenset(x.encode().split(b"+")) for x in s.split())
    out = [Rule(label, "base", 0, 1.0, words(max(phrase.split(), key=len)), phrase, True) for phrase, label in BASE]
    out += [Rule(label, t, priority, sure, words(keys), form % f"(?:{name})") for label, keys, name in NAMES for t, priority, form, sure in TEMPLATES]
    out += [Rule(label, "sentence", priority, sure, words(key), form) for label, priority, key, form, sure in SENTENCES]
    return sorted(out, key=lambda r: r.priority)


class _Reach:
    """Largest end of the intervals whose start is at most s: a binary indexed tree over the starts."""

    def __init__(self, starts: list[int]):
        self.starts, self.ends = sorted(set(starts)), [-1] * (len(starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def until(self, start: int) -> int:
        i, best = bisect_right(self.starts, start), -1
        while i:
            best = max(best, self.ends[i])
            i -= i & -i
        return best


def resolve(found: list[tuple]) -> list[tuple]:
    """Matches (priority, start, end, label, certainty, base) that stand: none inside one that was accepted before, but base ones."""
    reach, accepted = _Reach([m[1] for m in found]), []
    for m in sorted(found, key=lambda m: (m[0], m[1] - m[2], m[1], m[3])):
        if m[5] or reach.until(m[1]) < m[2]:
            accepted.append(m)
            reach.add(m[1], m[2])
    return accepted


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.gates = frozenset(w for r in self.rules for k in r.keywords for w in k)
        self.opens: dict[bytes, dict[frozenset[bytes], list[int]]] = {}  # by the longest word of a gate
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                self.opens.setdefault(max(k, key=lambda w: (len(w), w)), {}).setdefault(k, []).append(i)

    def opened(self, words: list[bytes]) -> list[Rule]:
        """The rules whose gate the words open, in their order."""
        here = self.gates.intersection(words)
        return [self.rules[i] for i in sorted({i for w in here for k, some in self.opens.get(w, {}).items() if k <= here for i in some})]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple]]:
        """Number of words, and the matches that stand, by their first word and the one behind their last."""
        words = (text or b"").translate(C.WORD_BYTES).split(b" ")
        words = list(filter(None, words))
        rules = self.opened(words)
        if not rules:
            return len(words), []
        line = b" " + b" ".join(words) + b" "
        found = []
        for r in rules:
            for m in r.find(line):
                a, b = m.span(1) if r.base else m.span()
                found.append((r.priority, a, b, r.label, r.certainty, r.base))
        if not found:
            return len(words), []
        blanks = np.cumsum(np.frombuffer(line, np.uint8) == 32)  # up to each byte: a match begins behind a blank and ends before one
        found = [(p, int(blanks[a - 1]) - 1, int(blanks[b - 1]), label, sure, base) for p, a, b, label, sure, base in found]
        return len(words), resolve(found)


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,first:long,last:long,certainty:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    one = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("certainty", pa.float64())])
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(one)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for batch in C.slices(batches):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), C.text_bytes(batch.column(1))):
            n, found = scanner.scan(text)
            base = [m for m in found if m[5]]
            starts = [m[1] for m in base]
            sure: dict[str, float] = {}
            for m in found:
                sure[m[3]] = max(sure.get(m[3], 0.0), m[4])
            miss = prod(1 - x for x in sure.values())
            out.append((
                doc_id, n, len(base), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({m[3] for m in base})), ",".join(sorted(sure)), 1 - miss,
                [{"label": m[3], "first": m[1], "last": m[2] - 1, "certainty": m[4]} for m in sorted(found, key=lambda m: m[1:4])],
            ))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one for each row of ``docs``.

    ``detections`` are the matches that stand, by their first and last word (from 0).
    ``score`` is 1 minus the product of the doubts of all labels: 0 without a label. Null texts
    count as empty. Other columns are not read; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCHEMA)
