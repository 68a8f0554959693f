"""Wordings of common licences: how notices name them, and the passages that their texts and notices open with."""

from __future__ import annotations

_FSF = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_FSF_ONLY = "you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Names by licence, as they follow "under the" (or "under" for those in _BARE) in a notice.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License v2.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CDDL-1.0": ("Common Development and Distribution License, Version 1.0", "CDDL 1.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"),
    "EUPL-1.2": ("European Union Public Licence, Version 1.2", "European Union Public Licence v1.2", "EUPL 1.2"),
    "GPL-1.0": ("GNU General Public License, version 1", "GNU General Public License v1.0", "GPLv1"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.0": ("GNU Library General Public License, version 2", "GNU Library General Public License v2.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License, Version 2"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal", "CC0 1.0"),
}

#: Whole sentences and bodies by licence.
PASSAGES = {
    "0BSD": (_ISC + ". THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",),
    "AGPL-3.0": (
        "This program is free software: " + _FSF.format("Affero General Public License", 3),
        "This program is free software: " + _FSF_ONLY.format("Affero General Public License", 3),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    "BSD": (_BSD[0],),
    "BSD-2-Clause": (f"{_BSD[0]}: 1. {_BSD[1]} 2. {_BSD[2]}", f"{_BSD[0]}: {_BSD[1]} {_BSD[2]}"),
    "BSD-3-Clause": (f"{_BSD[0]}: 1. {_BSD[1]} 2. {_BSD[2]} 3. {_BSD[4]}", f"{_BSD[0]}: {_BSD[1]} {_BSD[2]} {_BSD[4]}"),
    "BSD-4-Clause": (f"{_BSD[0]}: 1. {_BSD[1]} 2. {_BSD[2]} 3. {_BSD[3]} 4. {_BSD[4]}", f"{_BSD[0]}: {_BSD[1]} {_BSD[2]} {_BSD[3]} {_BSD[4]}"),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-1.0": ("This program is free software; " + _FSF.format("General Public License", 1).replace(" of the License,", ","),),
    "GPL-2.0": (
        "This program is free software; " + _FSF.format("General Public License", 2),
        "This program is free software; " + _FSF_ONLY.format("General Public License", 2),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This program is free software: " + _FSF.format("General Public License", 3),
        "This program is free software: " + _FSF_ONLY.format("General Public License", 3),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.0": ("This library is free software; " + _FSF.format("Library General Public License", 2), "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-2.1": (
        "This library is free software; " + _FSF.format("Lesser General Public License", 2.1),
        "This library is free software; " + _FSF_ONLY.format("Lesser General Public License", 2.1),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "This program is free software: " + _FSF.format("Lesser General Public License", 3),
        "This library is free software: " + _FSF_ONLY.format("Lesser General Public License", 3),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
}

_BARE = {"AGPLv3", "AGPL-3.0", "CDDL 1.0", "EUPL 1.2", "GNU AGPL v3", "GNU GPL v2", "GNU GPL v3", "GNU LGPL v2.1", "GNU LGPL v3", "GPLv1", "GPLv2", "GPL-2.0", "GPLv3", "GPL-3.0", "LGPLv2.1", "LGPL-2.1", "LGPLv3", "LGPL-3.0", "MPL 1.1", "MPL 2.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _wordings() -> dict[str, tuple[str, ...]]:
    out: dict[str, list[str]] = {}
    for licence, names in NAMES.items():
        own = out.setdefault(licence, [])
        for name in names:
            for article in ("the ", "") if name in _BARE else ("the ",):
                own += [f"Licensed under {article}{name}.", f"Released under {article}{name}.", f"under {article}{name}"]
            own.append(f"This work is licensed under the {name}.")
    for kind, title in _CC.items():
        for version, port in _CC_VERSIONS.items():
            own = out.setdefault(f"CC-{kind}-{version}", [])
            own += [f"Licensed under CC {kind} {version}.", f"under CC {kind} {version}", f"under the CC {kind} {version} license"]
            own += [f"This work is licensed under a Creative Commons {title} {version} {port} License.", f"under a Creative Commons {title} {version} {port} License", f"under the Creative Commons {title} {version} {port} License", f"under the Creative Commons {title} {version} License", f"Creative Commons {title} {version} {port}"]
            if version < "4.0" and "ND" in kind:  # the older titles
                own += [w.replace("NoDerivatives", "NoDerivs") for w in own if "NoDerivatives" in w]
    for licence, passages in PASSAGES.items():
        out.setdefault(licence, []).extend(passages)
    for licence, own in out.items():
        if licence != "BSD":
            own.append(f"SPDX-License-Identifier: {licence}")
    return {licence: tuple(dict.fromkeys(own)) for licence, own in sorted(out.items())}


WORDINGS = _wordings()
