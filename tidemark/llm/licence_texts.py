"""Wording of well-known licences and notices, as their stewards publish it
(opensource.org, spdx.org, gnu.org, apache.org, mozilla.org, creativecommons.org)."""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor."""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
allowed as long as the name is changed."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at"""


def _gnu(program: str, licence: str, version: str) -> str:
    return f"""{program} is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by
        the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""  # fmt: skip


#: Templates: label, text. A notice and the longer text that contains it have templates of their own.
TEMPLATES = (
    ("mit-text", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-notice", "released under the MIT License"),
    ("mit-notice", "licensed under the MIT License"),
    ("bsd-2-text", f"{_BSD_HEAD} {_BSD_WARRANTY}"),
    ("bsd-3-text", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-text", _ISC),
    ("zlib-text", _ZLIB),
    ("unlicense-text", _UNLICENSE),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("boost-text", _BOOST),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("wtfpl-text", _WTFPL),
    ("apache-notice", _APACHE),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("mpl-notice", _MPL),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("epl-notice", _EPL),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ofl-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("gpl-notice", _gnu("This program", "GNU General Public License", "3")),
    ("gpl-notice", _gnu("This program", "GNU General Public License", "2")),
    ("lgpl-notice", _gnu("This library", "GNU Lesser General Public License", "2.1")),
    ("lgpl-notice", _gnu("This program", "GNU Lesser General Public License", "3")),
    ("agpl-notice", _gnu("This program", "GNU Affero General Public License", "3")),
    ("gpl-notice", "this work is licensed under the GNU General Public License version 3"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-notice", "licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "licensed under CC BY 4.0"),
    ("cc-by-sa-notice", "licensed under CC BY-SA 4.0"),
    ("mit-spdx", "SPDX-License-Identifier: MIT"),
    ("apache-spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-spdx", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc-spdx", "SPDX-License-Identifier: ISC"),
    ("mpl-spdx", "SPDX-License-Identifier: MPL-2.0"),
    ("gpl-spdx", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-spdx", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl-spdx", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl-spdx", "SPDX-License-Identifier: LGPL-3.0"),
    ("agpl-spdx", "SPDX-License-Identifier: AGPL-3.0"),
    ("cc0-spdx", "SPDX-License-Identifier: CC0-1.0"),
    ("zlib-spdx", "SPDX-License-Identifier: Zlib"),
    ("unlicense-spdx", "SPDX-License-Identifier: Unlicense"),
    ("boost-spdx", "SPDX-License-Identifier: BSL-1.0"),
    ("ofl-spdx", "SPDX-License-Identifier: OFL-1.1"),
    ("epl-spdx", "SPDX-License-Identifier: EPL-2.0"),
)
