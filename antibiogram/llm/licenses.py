"""License notices that ``license_scan`` looks for.

A template is a text; words in double brackets must stand in the document next to each other, as they are: they name the
license and tell it from its kin (name, version, restrictions). Long licenses are known by the notice that files carry;
callers may pass their full texts as further templates.
"""

from __future__ import annotations

#: Short notices by which texts state their license.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the [[Apache License, Version 2.0]].",
        "Licensed under the [[Apache License 2.0]].",
        'Licensed under the [[Apache License, Version 2.0]] (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "Apache": ("Released under the [[Apache License]].",),
    "MIT": ("Released under the [[MIT License]].",),
    "BSD": ("Released under the [[BSD License]].",),
    "BSD-2-Clause": ("Released under the [[BSD 2-Clause]] License.", "Released under the [[2-Clause BSD]] License."),
    "BSD-3-Clause": ("Released under the [[BSD 3-Clause]] License.", "Released under the [[3-Clause BSD]] License."),
    "ISC": ("Released under the [[ISC License]].",),
    "MPL-2.0": (
        "Released under the [[Mozilla Public License, version 2.0]].",
        "This Source Code Form is subject to the terms of the [[Mozilla Public License, v. 2.0]].",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the [[Eclipse Public License 2.0]]",),
    "BSL-1.0": ("Distributed under the [[Boost Software License, Version 1.0]].",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under [[CC0 1.0]].",),
}

#: The GNU licenses, by name in notices and version.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}

#: Elements of the Creative Commons licenses, and their versions.
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the [[names of its contributors may be used to endorse]] or promote products derived from this software without specific prior written permission."

#: Whole license texts, without their copyright lines.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD": (_BSD,),
    "BSD-2-Clause": (f"{_BSD}: 1. {_BSD_1} 2. {_BSD_2} {_WARRANTY}",),
    "BSD-3-Clause": (f"{_BSD}: 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_WARRANTY}", f"{_BSD}: {_BSD_1} {_BSD_2} {_BSD_3}"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

#: Identifiers that are looked for behind "SPDX-License-Identifier:", besides those above.
SPDX = ("0BSD", "Artistic-2.0", "EPL-1.0", "EUPL-1.2", "MIT-0", "MPL-1.1", "OFL-1.1", "Python-2.0")


def _gnu() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            out[spdx] = (f"This work is licensed under the [[{name}, version {v}]].", f"Licensed under the [[{name}, version {v}]].", f"Released under the [[{name} v{v}]].", f"Released under the [[{short}v{v}]].")
            out[f"{spdx}-or-later"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the [[{name}]] as published by the Free Software Foundation, either [[version {v}]] of the License, or (at your option) any [[later version]].",
            )
            out[f"{spdx}-only"] = (
                f"This program is free software; you can redistribute it and/or modify it under the terms of the [[{name} version {v}]] as published by the Free Software Foundation.",
            )
    return out


def _creative_commons() -> dict[str, tuple[str, ...]]:
    return {
        f"CC-{short}-{v}": (f"Licensed under [[CC {short} {v}]].", f"This work is licensed under a Creative Commons [[{name} {v}]] International License.")
        for short, name in CC.items()
        for v in CC_VERSIONS
    }


def templates() -> list[tuple[str, str]]:
    """(license, text) of every template."""
    found: dict[str, list[str]] = {}
    for part in (NOTICES, TEXTS, _gnu(), _creative_commons()):
        for name, texts in part.items():
            found.setdefault(name, []).extend(texts)
    for name in [*found, *SPDX]:
        if name not in ("Apache", "BSD"):
            found.setdefault(name, []).append(f"[[SPDX-License-Identifier: {name}]]")
    return [(name, text) for name, texts in found.items() for text in texts]
