"""Pages made by hand, each unlike the sample pages in one way, with the main text that is wanted."""

ONE = "The first paragraph tells what happened at the harbour on a cold morning in March."
TWO = "The second paragraph says why nobody had seen it coming, although the signs were there."
THREE = "The last paragraph closes the story and thanks those who helped with it."
STORY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = f"{ONE}\n\n{TWO}\n\n{THREE}"
MENU = "<nav><ul>" + "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(9)) + "</ul></nav>"
FOOT = "<footer><p>Copyright of the publisher, all rights reserved, imprint and terms of use.</p></footer>"
COMMENT = "I have read this twice and must say that I do not agree with a word of it."


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = {
    "plain article": (page(f"{MENU}<article><h1>Harbour</h1>{STORY}</article>{FOOT}"), f"Harbour\n\n{TEXT}"),
    "form around the page": (page(f'<form id="aspnetForm">{MENU}<div id="main"><h1>Harbour</h1>{STORY}</div>{FOOT}</form>'), f"Harbour\n\n{TEXT}"),
    "form around an article": (page(f'<form method="post"><input type="hidden">{MENU}<article>{STORY}</article>{FOOT}</form>'), TEXT),
    "sign-up form inside": (page(f"<article><p>{ONE}</p><form>Your mail <input><button>Send</button></form><p>{TWO}</p><p>{THREE}</p></article>"), TEXT),
    "comment articles inside": (page(f'<article>{STORY}<article class="comment"><p>{COMMENT}</p></article></article>'), TEXT),
    "comment articles after": (page(f'<main><article>{STORY}</article><article class="comment"><p>{COMMENT}</p></article><article class="comment reply"><p>{COMMENT}</p></article></main>'), TEXT),
    "comment section": (page(f'<article>{STORY}</article><section id="comments"><h2>Comments</h2><ol><li><p>{COMMENT}</p></li></ol></section>'), TEXT),
    "comment paragraphs": (page(f'<article>{STORY}<p class="comment">{COMMENT}</p></article>'), TEXT),
    "named words in a sentence": (
        page(f'<article><p>He holds a <span class="share">large share</span> of a <a class="related" href=/x>related company</a>.</p>{STORY}</article>'),
        f"He holds a large share of a related company.\n\n{TEXT}",
    ),
    "menu as a table of dishes": (page(f'<article>{STORY}<table class="menu"><tr><td>Soup of the day</td><td>five crowns</td></tr></table></article>'), f"{TEXT}\n\nSoup of the day\n\nfive crowns"),
    "layout table": (page(f'<table><tr><td class="sidebar"><a href=/a>One</a> <a href=/b>Two</a></td><td class="text">{STORY}</td></tr></table>'), TEXT),
    "heading before nested divs": (page(f"{MENU}<article><h1>Harbour</h1><div><div><div><div>{STORY}</div></div></div></div></article>{FOOT}"), f"Harbour\n\n{TEXT}"),
    "one-word items at the end": (page(f"{MENU}<article>{STORY}<ul><li>boats</li><li>ropes</li><li>nets</li></ul></article>{FOOT}"), f"{TEXT}\n\nboats\n\nropes\n\nnets"),
    "headings without words beside them": (page(f"<article><h1>Harbour</h1><h2>March</h2><div></div><div></div><div><h3>Early</h3></div>{STORY}</article>"), f"Harbour\n\nMarch\n\nEarly\n\n{TEXT}"),
    "divs only": (page(f'<div class="top"><a href=/>Home</a> <a href=/n>News</a></div><div class="story"><div>{ONE}</div><div>{TWO}</div><div>{THREE}</div></div><div class="footer">All rights</div>'), TEXT),
    "several articles": (page(f"{MENU}<main><article><h2>A</h2>{STORY}</article><article><h2>B</h2>{STORY}</article></main>{FOOT}"), f"A\n\n{TEXT}\n\nB\n\n{TEXT}"),
    "article that may be commented": (page(f'<article class="post comments-open">{STORY}</article>'), TEXT),
    "related links inside": (page(f'<article><p>{ONE}</p><div class="related"><a href=/1>Read this</a><a href=/2>And that</a></div><p>{TWO}</p><p>{THREE}</p></article>'), TEXT),
    "advert inside": (page(f'<article><p>{ONE}</p><div class="ad-box">Buy a boat now and save</div><p>{TWO}</p><p class="advert">Ropes at half price</p><p>{THREE}</p></article>'), TEXT),
    "cookie notice around nothing": (page(f'<div class="cookie-notice"><p>We use cookies, please accept them all.</p></div><article>{STORY}</article>'), TEXT),
    "header inside an article": (page(f"{MENU}<article><header><h1>Harbour</h1><p>By our reporter at the coast</p></header>{STORY}</article>"), f"Harbour\n\nBy our reporter at the coast\n\n{TEXT}"),
    "quotes, code and tables": (
        page(f"<article><p>{ONE}</p><blockquote>So it was said.</blockquote><pre>a = b + c</pre><table><tr><th>Year</th><td>1953</td></tr></table><p>{TWO}</p></article>"),
        f"{ONE}\n\nSo it was said.\n\na = b + c\n\nYear\n\n1953\n\n{TWO}",
    ),
    "short": (page(f"{MENU}<article><p>Just this.</p></article>{FOOT}"), "Just this."),
    "nothing but a menu": (page(MENU), ""),
}
