"""Pages and contents in other phrasings, written together with the rules of structure and not corrected on since."""

PAGES = [
    "Our viewer requires JavaScript. Please enable it and reload.",
    "403 Forbidden\nPlease sign out and sign in again.",
    "It looks like JavaScript is switched off in your browser. To view the catalog you will have to turn it on, and after that you may need to reload this page once or twice until all of its parts have been fetched.",
    "To use all functions of this site it is necessary to enable JavaScript in your browser. Here are instructions how to enable JavaScript.",
    "You need to enable JavaScript to run this app.",
    "500 Internal Server Error. Our crawler could not reach the upstream service. Please try again later.",
    "The page you were looking for doesn't exist. You may have mistyped the address.",
    "Sorry, we can't find that page. It might have been removed or renamed.",
    "HTTP 502 Bad Gateway\nThe order book is offline right now. Please come back in a few minutes.",
    "This site is protected against robots. Prove that you are human to go on.",
    "503 Service Unavailable\nPlease contact the administrator of this server if the problem persists for more than an hour, and tell them the time at which it occurred together with the address that you were trying to open.",
    "Home About Contact Help Search Login Register Sitemap Privacy Terms Imprint Cookies Blog News FAQ\n404 Not Found",
    "Dieses Angebot benötigt JavaScript. Bitte schalten Sie es in Ihrem Browser ein.",
    "Ce site a besoin de JavaScript. Veuillez l'activer dans les réglages de votre navigateur.",
    "Esta página necesita JavaScript para funcionar. Por favor, actívelo y vuelva a cargar.",
    "本网站需要 JavaScript 支持,请在浏览器设置中启用后刷新。",
    "Your session has expired. Please sign in again to carry on with what you were doing before.",
    "Fatal error: Allowed memory size exhausted",
    "We noticed that cookies are blocked. Allow cookies for this site and try again.",
    "Zugriff verweigert. Sie haben keine Berechtigung, diese Seite zu öffnen.",
    "429 Too Many Requests. Please slow down.",
    "Unfortunately this content could not be loaded. Retry",
    "Access to the vendor portal is denied. Please ask your administrator.",
    "Unsupported browser: scripts must be allowed for the attached viewer. Please switch them on.",
]
CONTENT = [
    "JavaScript is not required to read this report.",
    "We enabled JavaScript in the viewer and repeated the measurement.",
    "The script needs 3 h on one node and reads all fingerprints.",
    "This page works without JavaScript.",
    "The lot came back with error 404 in the shop, so we bought it from another vendor.",
    "Please stir 5 g of the acid in 20 mL of water.",
    "Our parser must handle pages that require JavaScript; the table below lists them.",
    "Das Skript liest die Datei und benötigt zwei Minuten.",
    "404 mg of the amine was obtained.",
    "Enable the stirrer, then add 3 mL of DMF.",
    "The server returned 503 Service Unavailable twice during the upload; I restarted the job in the evening.",
    "JavaScript n’est pas nécessaire pour lire ce rapport.",
]
