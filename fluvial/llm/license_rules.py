"""Hand-written signatures of licences over normalised words (lower case A-Z, one space between words, so "CC BY-SA 4.0" is
"cc by sa 4 0"). One rule a line: label | keywords that must all occur | regular expression. A header line gives the priority
and strength of the rules below it. A keyword is a plain substring of the normalised text; it only gates its rule. In
patterns VER stands for a word for a version; "license" stands for both spellings, since "licence" is read as it. Gaps are bounded, so each rule is
linear in the text. Within one priority the order of the lines breaks ties."""

RULES = r"""
== base 100 0.5
cc-by | cc by | cc by
gpl | general public license | general public license
reserved | all rights reserved | all rights reserved

== text 90 1.0
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit-0 | to whom the software is furnished to do so the software is provided | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction(?: \S+){0,32} to whom the software is furnished to do so the software is provided as is
isc | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2-clause | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | be used to endorse or promote products derived | neither the names? of (?:the )?(?:\S+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products derived
bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-no-warranty | this software is provided by the copyright holders | this software is provided by the (?:regents|copyright holders|authors?)(?: and contributors)? as is and any express or implied warranties
apache-2.0 | licensed under the apache | licensed under the apache license(?: VER)? ?(?:v ?)?2(?: 0)?(?: the license)? you may not use this file except in compliance with the license
apache-2.0 | you may obtain a copy of the license at | you may obtain a copy of the license at https? www apache org licenses license 2 0
gpl-2.0-or-later | either version 2 of the license | (?:redistribute it and or modify it under the terms of )?the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 of the license | (?:redistribute it and or modify it under the terms of )?the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | gnu general public license version 2 | the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0-only | gnu general public license version 3 | the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation
lgpl-2.1-or-later | lesser general public | the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | lesser general public | the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | library general public | the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | affero general public | the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gfdl-1.3-or-later | free documentation license version 1 3 | under the terms of the gnu free documentation license version 1 3 or any later version
gfdl-1.2-or-later | free documentation license version 1 2 | under the terms of the gnu free documentation license version 1 2 or any later version
gpl-text | everyone is permitted to copy and distribute verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-text | the licenses for most software are designed | the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change
mpl-2.0 | mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license 2 0 | made available under the terms of the eclipse public license(?: v)? 2 0
cddl-1.0 | common development and distribution license | subject to the terms of the common development and distribution license(?: the license)?(?: VER 1 0)?
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
zlib | in no event will the authors be held liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0 | a copy of the software and accompanying documentation covered by this license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ncsa | to deal with the software without restriction | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction
postgresql | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
curl | permission to use copy modify and distribute this software for any purpose | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
python-2.0 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | this product includes software developed by the openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation
ofl-1.1 | sil open font license version 1 1 | this font software is licensed under the sil open font license version 1 1
afl-3.0 | academic free license version 3 0 | licensed under the academic free license version 3 0
osl-3.0 | open software license version 3 0 | licensed under the open software license version 3 0
ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license
beerware | as long as you retain this notice you | as long as you retain this notice you can do whatever you want with this stuff
json | shall be used for good not evil | the software shall be used for good not evil
cc0-1.0 | cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc-legal-code | creative commons corporation is not a law firm | creative commons corporation (?:creative commons )?is not a law firm and does not provide legal services
public-domain | placed in the public domain | the author(?:s)? disclaims? copyright to this source code|has been placed in the public domain
crown | crown copyright | contains public sector information licensed under the open government license v ?3 0
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
libpng | png development group | this copy of the libpng notices is provided for your convenience
artistic-2.0 | the standard version | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms
w3c | w3c software | this work is being provided by the copyright holders under the following license|w3c software notice and license
proprietary | confidential and proprietary | (?:is|contains|are) (?:the )?confidential and proprietary(?: information| property)? (?:of|to)
proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited

== id 80 0.95
spdx-mit | spdx license identifier mit | spdx license identifier mit
spdx-apache-2.0 | spdx license identifier apache | spdx license identifier apache 2 0
spdx-gpl-2.0 | spdx license identifier gpl 2 0 | spdx license identifier gpl 2 0(?: only| or later)?
spdx-gpl-3.0 | spdx license identifier gpl 3 0 | spdx license identifier gpl 3 0(?: only| or later)?
spdx-bsd | spdx license identifier bsd | spdx license identifier bsd [1-4] clause
spdx-mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0
spdx-lgpl | spdx license identifier lgpl | spdx license identifier lgpl [23] [01](?: only| or later)?
spdx-agpl-3.0 | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
spdx-cc | spdx license identifier cc | spdx license identifier cc(?: by| nc| nd| sa| 0){1,4}(?: \d 0)?
spdx-other | spdx license identifier | spdx license identifier
gpl-1.0-only | gpl 1 0 | gpl 1 0 only
gpl-1.0-or-later | gpl 1 0 | gpl 1 0 or later
gpl-2.0-only | gpl 2 0 only | gpl 2 0 only
gpl-2.0-or-later | gpl 2 0 or later | gpl 2 0 or later
gpl-3.0-only | gpl 3 0 only | gpl 3 0 only
gpl-3.0-or-later | gpl 3 0 or later | gpl 3 0 or later
lgpl-2.0-only | lgpl 2 0 only | lgpl 2 0 only
lgpl-2.0-or-later | lgpl 2 0 or later | lgpl 2 0 or later
lgpl-2.1-only | lgpl 2 1 only | lgpl 2 1 only
lgpl-2.1-or-later | lgpl 2 1 or later | lgpl 2 1 or later
lgpl-3.0-only | lgpl 3 0 only | lgpl 3 0 only
lgpl-3.0-or-later | lgpl 3 0 or later | lgpl 3 0 or later
agpl-3.0-only | agpl 3 0 only | agpl 3 0 only
agpl-3.0-or-later | agpl 3 0 or later | agpl 3 0 or later
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-2.5 | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-2.0 | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-1.0 | cc by sa 1 0 | cc by sa 1 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-2.5 | cc by nc sa 2 5 | cc by nc sa 2 5
cc-by-nc-sa-2.0 | cc by nc sa 2 0 | cc by nc sa 2 0
cc-by-nc-sa-1.0 | cc by nc sa 1 0 | cc by nc sa 1 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-2.5 | cc by nc nd 2 5 | cc by nc nd 2 5
cc-by-nc-nd-2.0 | cc by nc nd 2 0 | cc by nc nd 2 0
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-2.5 | cc by nc 2 5 | cc by nc 2 5
cc-by-nc-2.0 | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-1.0 | cc by nc 1 0 | cc by nc 1 0
cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
cc-by-nd-3.0 | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-2.5 | cc by nd 2 5 | cc by nd 2 5
cc-by-nd-2.0 | cc by nd 2 0 | cc by nd 2 0
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-3.0 | cc by 3 0 | cc by 3 0
cc-by-2.5 | cc by 2 5 | cc by 2 5
cc-by-2.0 | cc by 2 0 | cc by 2 0
cc-by-1.0 | cc by 1 0 | cc by 1 0
cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
bsd-1-clause | bsd 1 clause | bsd 1 clause
bsd-2-clause | bsd 2 clause | bsd 2 clause(?: patent| views)?
bsd-3-clause | bsd 3 clause | bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause | bsd 4 clause | bsd 4 clause(?: uc)?
apache-1.1 | apache 1 1 | apache 1 1
apache-2.0 | apache 2 0 | apache 2 0(?: with llvm exception)?
mpl-1.1 | mpl 1 1 | mpl 1 1
mpl-2.0 | mpl 2 0 | mpl 2 0(?: no copyleft exception)?
epl-1.0 | epl 1 0 | epl 1 0
epl-2.0 | epl 2 0 | epl 2 0
eupl-1.1 | eupl 1 1 | eupl 1 1
eupl-1.2 | eupl 1 2 | eupl 1 2
cddl-1.0 | cddl 1 0 | cddl 1 0
cddl-1.1 | cddl 1 1 | cddl 1 1
ofl-1.1 | ofl 1 1 | ofl 1 1
bsl-1.0 | bsl 1 0 | bsl 1 0
busl-1.1 | busl 1 1 | busl 1 1
sspl-1.0 | sspl 1 0 | sspl 1 0
odbl-1.0 | odbl 1 0 | odbl 1 0
odc-by-1.0 | odc by 1 0 | odc by 1 0
pddl-1.0 | pddl 1 0 | pddl 1 0
cdla-permissive-2.0 | cdla permissive | cdla permissive [12] 0
cdla-sharing-1.0 | cdla sharing | cdla sharing 1 0
afl-3.0 | afl 3 0 | afl 3 0
osl-3.0 | osl 3 0 | osl 3 0
artistic-2.0 | artistic 2 0 | artistic 2 0
elastic-2.0 | elastic 2 0 | elastic 2 0
upl-1.0 | upl 1 0 | upl 1 0
mulan-psl-2.0 | mulanpsl 2 0 | mulanpsl 2 0
cecill-2.1 | cecill 2 1 | cecill 2 1
ecl-2.0 | ecl 2 0 | ecl 2 0

== name 70 0.9
gpl-3.0-or-later | general public | (?:gnu )?general public license(?: gpl)?(?: VER)? ?(?:v ?)?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl-2.0-or-later | general public | (?:gnu )?general public license(?: gpl)?(?: VER)? ?(?:v ?)?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
lgpl-3.0 | lesser general public | (?:gnu )?lesser general public license(?: lgpl)?(?: VER)? ?(?:v ?)?3(?: 0)?
lgpl-2.1 | lesser general public | (?:gnu )?lesser general public license(?: lgpl)?(?: VER)? ?(?:v ?)?2 1
lgpl-2.0 | library general public | (?:gnu )?library general public license(?: lgpl)?(?: VER)? ?(?:v ?)?2(?: 0)?
agpl-3.0 | affero general public | (?:gnu )?affero general public license(?: agpl)?(?: VER)? ?(?:v ?)?3(?: 0)?
agpl-1.0 | affero general public | affero general public license(?: VER)? ?(?:v ?)?1(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public license(?: gpl)?(?: VER)? ?(?:v ?)?3(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public license(?: gpl)?(?: VER)? ?(?:v ?)?2(?: 0)?
gpl-1.0 | general public | (?:gnu )?general public license(?: gpl)?(?: VER)? ?(?:v ?)?1(?: 0)?
gfdl-1.3 | free documentation | (?:gnu )?free documentation license(?: gfdl)?(?: VER)? ?(?:v ?)?1 3
gfdl-1.2 | free documentation | (?:gnu )?free documentation license(?: gfdl)?(?: VER)? ?(?:v ?)?1 2
gfdl-1.1 | free documentation | (?:gnu )?free documentation license(?: gfdl)?(?: VER)? ?(?:v ?)?1 1
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: or later)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: or later)?
gpl-3.0 | gpl 3 | (?:gnu )?gpl (?:VER )?3(?: 0)?
gpl-2.0 | gpl 2 | (?:gnu )?gpl (?:VER )?2(?: 0)?
gpl-3.0 | gpl v3 | (?:gnu )?gpl v3(?: 0)?
gpl-2.0 | gpl v2 | (?:gnu )?gpl v2(?: 0)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | lgplv2 1 | (?:gnu )?lgplv2 1
lgpl-2.1 | lgpl v2 1 | (?:gnu )?lgpl v2 1
lgpl-3.0 | lgpl v3 | (?:gnu )?lgpl v3
agpl-3.0 | agplv3 | (?:gnu )?agplv3
agpl-3.0 | agpl v3 | (?:gnu )?agpl v3
apache-2.0 | apache | apache (?:software )?license(?: VER)? ?(?:v ?)?2(?: 0)?
apache-1.1 | apache | apache (?:software )?license(?: VER)? ?(?:v ?)?1 1
apache-1.0 | apache | apache (?:software )?license(?: VER)? ?(?:v ?)?1 0
apache-2.0 | apache org licenses | apache org licenses license 2 0
mit | mit license | (?:the )?mit license
mit | expat license | expat license
mit-x11 | mit x11 | mit x11(?: license)?
x11 | x11 license | x11 license
isc | isc license | isc license
bsd-2-clause | 2 clause bsd | (?:the )?(?:simplified )?2 clause bsd(?: license)?
bsd-2-clause | simplified bsd | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
bsd-3-clause | 3 clause bsd | (?:the )?3 clause bsd(?: license)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd license
bsd-4-clause | bsd | (?:original|old|4 clause) bsd license
0bsd | bsd zero clause | bsd zero clause license
mpl-2.0 | mozilla public | mozilla public license(?: mpl)?(?: VER)? ?(?:v ?)?2 0
mpl-1.1 | mozilla public | mozilla public license(?: mpl)?(?: VER)? ?(?:v ?)?1 1
mpl-1.0 | mozilla public | mozilla public license(?: mpl)?(?: VER)? ?(?:v ?)?1 0
epl-2.0 | eclipse public | eclipse public license(?: epl)?(?: VER)? ?(?:v ?)?2 0
epl-1.0 | eclipse public | eclipse public license(?: epl)?(?: VER)? ?(?:v ?)?1 0
edl-1.0 | eclipse distribution | eclipse distribution license(?: VER)? ?(?:v ?)?1 0
eupl-1.2 | european union public | european union public license(?: eupl)?(?: VER)? ?(?:v ?)?1 2
eupl-1.1 | european union public | european union public license(?: eupl)?(?: VER)? ?(?:v ?)?1 1
cddl-1.0 | common development and distribution | common development and distribution license(?: cddl)?(?: VER)? ?(?:v ?)?1 0
cpl-1.0 | common public license | common public license(?: VER)? ?(?:v ?)?1 0
cpal-1.0 | common public attribution | common public attribution license(?: VER)? ?(?:v ?)?1 0
ipl-1.0 | ibm public license | ibm public license(?: VER)? ?(?:v ?)?1 0
bsl-1.0 | boost software | boost software license(?: VER)? ?(?:v ?)?1 0
busl-1.1 | business source license | business source license(?: VER)? ?(?:v ?)?1 1
sspl-1.0 | server side public | server side public license(?: sspl)?(?: VER)? ?(?:v ?)?1
elastic-2.0 | elastic license | elastic license(?: VER)? ?(?:v ?)?2(?: 0)?
elastic-1.0 | elastic license | elastic license(?: VER)? ?(?:v ?)?1(?: 0)?
polyform-nc-1.0 | polyform noncommercial | polyform noncommercial(?: license)?(?: 1 0 0)?
polyform-sb-1.0 | polyform small business | polyform small business(?: license)?(?: 1 0 0)?
commons-clause | commons clause | commons clause(?: license)?(?: condition)?(?: v1 0)?
artistic-2.0 | artistic license | artistic license(?: VER)? ?(?:v ?)?2 0
artistic-1.0 | artistic license | artistic license(?: VER)? ?(?:v ?)?1 0
python-2.0 | python software foundation | python software foundation license(?: VER)?(?: ?(?:v ?)?2)?
php-3.01 | php license | php license(?: VER)? ?(?:v ?)?3 01
ruby | ruby license | ruby license
zlib | zlib license | zlib(?: libpng)? license
zpl-2.1 | zope public | zope public license(?: VER)? ?(?:v ?)?2 1
ncsa | university of illinois | university of illinois(?: ncsa)? open source license
ofl-1.1 | open font | (?:sil )?open font license(?: ofl)?(?: VER)?(?: ?(?:v ?)?1 1)?
ubuntu-font-1.0 | ubuntu font | ubuntu font license(?: VER)?(?: ?(?:v ?)?1 0)?
afl-3.0 | academic free | academic free license(?: VER)? ?(?:v ?)?3 0
osl-3.0 | open software license | open software license(?: VER)? ?(?:v ?)?3 0
rpl-1.5 | reciprocal public | reciprocal public license(?: VER)?(?: ?(?:v ?)?1 [15])?
ms-pl | microsoft public | microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license
nasa-1.3 | nasa open source | nasa open source agreement(?: VER)?(?: 1 3)?
apsl-2.0 | apple public source | apple public source license(?: VER)?(?: ?(?:v ?)?[12] [0-2])?
postgresql | postgresql license | postgresql license
unlicense | the unlicense | (?:under )?the unlicense
wtfpl | wtfpl | wtfpl(?: VER)?(?: ?(?:v ?)?2)?
vim | vim license | vim license
openssl | openssl license | openssl license
lppl-1.3 | latex project public | latex project public license(?: VER)?(?: ?(?:v ?)?1 [0-3]c?)?
cecill-2.1 | cecill | (?:license |license )?cecill(?: VER)? ?(?:v ?)?2(?: [01])?
mulan-psl-2.0 | mulan permissive | mulan permissive software license(?: VER)?(?: ?(?:v ?)?[12])?
etalab-2.0 | license ouverte | license ouverte(?: open license)?(?: VER)?(?: ?(?:v ?)?[12] 0)?
ogl-3.0 | open government | open government license(?: VER)? ?(?:v ?)?3 0
ogl-2.0 | open government | open government license(?: VER)? ?(?:v ?)?2 0
odbl-1.0 | open database | open (?:data commons open )?database license(?: odbl)?(?: VER)?(?: ?(?:v ?)?1 0)?
odc-by-1.0 | open data commons attribution | open data commons attribution license(?: VER)?(?: ?(?:v ?)?1 0)?
pddl-1.0 | public domain dedication and license | (?:open data commons )?public domain dedication and license(?: pddl)?
cdla | community data license agreement | community data license agreement(?: permissive| sharing)?(?: VER)?(?: [12] 0)?
free-art-1.3 | free art license | free art license(?: 1 3)?
openrail | openrail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m| s| \+\+)?(?: license)?
llama-community | community license agreement | llama [234](?: [0-9])? community license agreement
cc-by-nc-sa-4.0 | attribution non | (?:creative commons )?attribution non ?commercial share ?alike(?: VER)? 4 0
cc-by-nc-nd-4.0 | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: VER)? 4 0
cc-by-nc-4.0 | attribution non | (?:creative commons )?attribution non ?commercial(?: VER)? 4 0
cc-by-nc-sa-3.0 | attribution non | (?:creative commons )?attribution non ?commercial share ?alike(?: VER)? 3 0
cc-by-nc-nd-3.0 | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: VER)? 3 0
cc-by-nc-3.0 | attribution non | (?:creative commons )?attribution non ?commercial(?: VER)? 3 0
cc-by-sa-4.0 | attribution share | (?:creative commons )?attribution share ?alike(?: VER)? 4 0
cc-by-sa-3.0 | attribution share | (?:creative commons )?attribution share ?alike(?: VER)? 3 0
cc-by-nd-4.0 | attribution no | (?:creative commons )?attribution no ?deriv(?:s|atives|ative works)(?: VER)? 4 0
cc-by-4.0 | creative commons attribution | creative commons attribution(?: VER)? 4 0
cc-by-3.0 | creative commons attribution | creative commons attribution(?: VER)? 3 0
cc-by-2.0 | creative commons attribution | creative commons attribution(?: VER)? 2 [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm-1.0 | creativecommons org publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?

== family 50 0.7
gpl | licensed under the gpl | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?gpl
gpl | under the gnu gpl | under the gnu gpl
gpl | gnu general public | gnu general public license
lgpl | lesser general public | (?:gnu )?lesser general public license
lgpl | gnu lgpl | gnu lgpl
agpl | affero general public | (?:gnu )?affero general public license
gfdl | free documentation | gnu free documentation license
gfdl | gfdl | gfdl
apache | apache license | apache license
apache | asl 2 0 | asl 2 0
bsd | bsd license | bsd(?: style)? license
bsd | bsd style | bsd style(?: license)?
bsd | bsd license | bsd license
mit | mit style | mit style(?: license)?
mit | licensed under mit | (?:licensed|released|distributed|available) under (?:the )?mit
mpl | mozilla public | mozilla public license
epl | eclipse public | eclipse public license
eupl | european union public | european union public license
cddl | common development and distribution | common development and distribution license
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc | cc by nc | cc by nc
cc-by-sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd
cc0 | cc0 | (?:creative commons )?cc0
cc-zero | creative commons zero | creative commons zero
cc-sampling | sampling plus | (?:creative commons )?sampling plus(?: 1 0)?
cc | creative commons license | (?:a )?creative commons license
cc | creative commons attribution | creative commons attribution
cc | lizenz creative commons | lizenz creative commons
cc | licencia creative commons | licencia creative commons
cc | license creative commons | license creative commons
artistic | artistic license | artistic license
ogl | open government | open government license
public-domain | public domain | (?:dedicated to|released into|placed in|in) the public domain
public-domain | dominio público | (?:de|en el) dominio público
public-domain | domaine public | (?:du|dans le) domaine public
public-domain | gemeinfrei | gemeinfrei
copyleft | copyleft | copyleft
open-source | open source license | (?:osi approved )?open source license
shared-source | shared source | (?:microsoft )?shared source(?: initiative)?(?: license)?
eula | end user license agreement | end user license agreement
fair-use | fair use | (?:constitutes|under|as) fair use
non-commercial | for non commercial use only | for non commercial use only
non-commercial | noncommercial use only | (?:for )?noncommercial use only
non-commercial | not for commercial use | not for commercial use
non-commercial | research purposes only | for (?:academic and |non commercial )?research purposes only
no-ai | text and data mining | (?:no|prohibits|reserves) (?:\S+ ){0,6}text and data mining
no-ai | ai training | (?:no|not|prohibited|may not) (?:\S+ ){0,8}ai training

== weak 20 0.4
reserved | some rights reserved | some rights reserved
reserved | rights reserved | (?:no|all other) rights reserved
reserved | alle rechte vorbehalten | alle rechte vorbehalten
reserved | tous droits réservés | tous droits réservés
reserved | todos los derechos reservados | todos los derechos reservados
reserved | tutti i diritti riservati | tutti i diritti riservati
reserved | todos os direitos reservados | todos os direitos reservados
reserved | alle rechten voorbehouden | alle rechten voorbehouden
copyright | copyright | copyright (?:c |© )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | copyright | copyright (?:by|of|holder|owner)s?
permission | reproduced with permission | reproduced with (?:the )?permission(?: of)?
permission | may not be reproduced | may not be reproduced(?: \S+){0,8} without (?:\S+ ){0,3}permission
permission | without prior written permission | without (?:the )?prior written permission(?: of)?
trademark | registered trademark | (?:is|are) (?:a )?registered trademarks?(?: of)?
patent | patent pending | patents? pending
terms | terms of use | (?:subject to|agree to|read) (?:the|our) terms of use
terms | terms of service | (?:subject to|agree to|read) (?:the|our) terms of service
licensed | licensed under | licensed under (?:the |a )?
"""
