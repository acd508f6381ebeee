"""Fixed values of the domain: word lists, lookup tables, patterns and formats that results depend on."""

from __future__ import annotations

# Fixed values. The order of the name rules matters: the first key found inside a name decides.
NAME_RULES = {
    "password": "password",
    "parola d'accesso": "password",
    "credenziali": "password",
    "pwd": "password",
    "dgue": "dgue",
    "documento unico europeo": "dgue",
    "documento unico": "dgue",
    "d.g.u.e.": "dgue",
    "empulia": "empulia",
    "piattaforma empulia": "empulia",
    "sistema empulia": "empulia",
    "em pulia": "empulia",
    "albo fornitori": "albo fornitori",
    "albo": "albo fornitori",
    "registro fornitori": "albo fornitori",
    "elenco fornitori": "albo fornitori",
    "iscrizione": "iscrizione",
    "registrazione": "iscrizione",
    "iscrizione albo": "iscrizione",
    "registrazione albo": "iscrizione",
    "fornitore": "fornitore",
    "operatore economico": "fornitore",
    "impresa": "fornitore",
    "ditta": "fornitore",
    "società": "fornitore",
    "documento": "documento",
    "documentazione": "documento",
    "documentazione richiesta": "documento",
    "allegato": "documento",
    "accesso": "accesso",
    "login": "accesso",
    "autenticazione": "accesso",
    "log in": "accesso",
    "entrata": "accesso",
    "procedura": "procedura",
    "processo": "procedura",
    "iter": "procedura",
    "prassi": "procedura",
    "cambiare": "modificare",
    "modificare": "modificare",
    "aggiornare": "modificare",
    "sostituire": "modificare",
    "reimpostare": "modificare",
    "reset": "reset",
    "ripristino": "reset",
    "azzeramento": "reset",
    "reimpostazione": "reset",
}
STOP_WORDS = [
    "il", "la", "lo", "gli", "le", "i", "un", "una", "uno", "del", "della", "dei", "delle", "dello", "degli", "di", "da", "in", "con", "per", "su",
    "tra", "fra", "a", "e", "o", "ma", "se", "come", "quando", "dove", "che", "chi", "cui", "quanto", "quale", "questo", "quello", "mio", "tuo",
    "suo", "nostro", "vostro", "loro", "mia", "tua", "sua", "nostra", "vostra",
]
TOC_STOP_WORDS = ["PER", "LA", "IL", "DI", "DEL", "DELLA", "E", "ED", "AL", "ALLA"]

# The ontology. The question analysis also knows NotificaSistema.
ENTITY_TYPES = [
    "PiattaformaModulo", "FunzionalitàPiattaforma", "RuoloUtente", "AzioneUtente", "OperazioneSistema", "InterfacciaUtenteElemento", "ComandoUI",
    "DocumentoSistema", "TipoDocumento", "Prerequisito", "Condizione", "ParametroConfigurazione", "Criterio", "StatoDocumento", "StatoProcedura",
    "EnteEsterno", "Organismo", "TermineTemporale", "Scadenza", "MessaggioSistema", "Notifica", "SezioneGuida",
]
QUESTION_ENTITY_TYPES = [*ENTITY_TYPES, "NotificaSistema"]
RELATION_TYPES = [
    "haPassoSuccessivo", "precede", "richiedeInput", "haCampo", "èEseguitaDa", "puòEseguire", "haSottoFunzionalità", "includeOperazione",
    "generaDocumento", "richiedeDocumento", "haPrerequisito", "èVincolatoDa", "haStato", "puòAvereStato", "interagisceCon", "inviaDatiA",
    "haTermine", "scadeIl", "mostraMessaggio", "produceNotifica", "èDescrittoIn", "provieneDa", "utilizzaFormula", "haCriterioDiValutazione",
    "siApplicaA", "riguarda", "èParteDi", "contieneElemento", "rimandaA",
]
NODE_LABELS = [
    "AzioneUtente", "DocumentoSistema", "FunzionalitaPiattaforma", "RuoloUtente", "ProceduraAmministrativa", "PiattaformaModulo",
    "InterfacciaUtenteElemento", "StatoProcedura", "NotificaSistema", "CriterioDiValutazione", "TermineTemporale",
]
EDGE_LABELS = [
    "richiede", "genera", "utilizza", "gestisce", "accede_a", "ESEGUITA_DA", "INCLUDE_FUNZIONALITA", "HA_STATO", "CONTIENE_ELEMENTO",
    "INVIA_NOTIFICA", "SI_APPLICA_A",
]

# Keywords of types and predicates; the first entry with a keyword inside the text decides.
TYPE_KEYWORDS = {
    "AzioneUtente": ["password", "accesso", "login", "autenticazione", "registrazione", "download", "upload", "invio"],
    "DocumentoSistema": ["documento", "pdf", "dgue", "allegato", "file", "modulo", "certificato", "fattura"],
    "FunzionalitaPiattaforma": ["piattaforma", "sistema", "funzione", "servizio", "modulo", "sezione"],
    "RuoloUtente": ["operatore", "utente", "amministratore", "responsabile", "rup", "direttore"],
    "ProceduraAmministrativa": ["procedura", "gara", "appalto", "bando", "contratto", "offerta", "manifestazione"],
}
PREDICATE_KEYWORDS = {
    "richiede": ["richiede", "necessita", "ha_bisogno_di", "dipende_da"],
    "genera": ["genera", "crea", "produce", "emette"],
    "utilizza": ["utilizza", "usa", "impiega", "si_serve_di"],
    "gestisce": ["gestisce", "amministra", "controlla", "supervisiona"],
    "accede_a": ["accede", "accede_a", "consulta", "visualizza"],
}
CLOSEST_PREDICATES = {
    "esegue": "puòEseguire",
    "eseguita": "èEseguitaDa",
    "parte": "èParteDi",
    "contiene": "contieneElemento",
    "richiede": "richiedeInput",
    "genera": "generaDocumento",
    "interagisce": "interagisceCon",
    "descritto": "èDescrittoIn",
}
DEFAULT_PREDICATE = "riguarda"

# Patterns of lines. All but PAGE_REFERENCE and LIST_ITEM ignore case.
HEADER_FOOTER = [r"Pag\.\s*\d+", r"Vers\.\s*\d+\.\d+", "QUESTO DOCUMENTO È DI PROPRIETÀ", r"Manuale per.*?\d{2}/\d{2}/\d{4}", r"^\d+$", "copyright|©|proprietà|innovapuglia"]
FIGURE_CAPTION = [r"^F\s*IGURA\s+\d+", r"^FIGURA\s+\d+", r"^Fig\.\s+\d+", r"^Figure\s+\d+", r"^\s*–\s*[A-Z][A-Z\s]+$", r"^F\s+IGURA\s+\d+\s*[-–]\s*[A-Z]", r"FIGURA\s+\d+\s*[-–]"]
TABLE_CAPTION = [r"^TABELLA\s+\d+", r"^TAB\.\s+\d+", r"^Table\s+\d+", "Tabella riepilogativa"]
PAGE_REFERENCE = [r"^\d+$", r"^\.\.\.\.\.\.\.\.\.\.\.\s*\d+$", r"^[A-Z\s]+\s+\.\.\.\.\.\.\.\.\.\.\.\s*\d+$", "INDICE DELLE FIGURE", "INDICE DELLE TABELLE"]
LIST_ITEM = [r"^\s*[•·▪▫◦‣⁃]\s+", r"^\s*[-–—]\s+", r"^\s*\d+[\.)]\s+", r"^\s*[a-zA-Z][\.)]\s+"]
TITLE_WORDS = ["REGISTRAZIONE|GESTIONE|ISTRUZIONI|ACCESSO|MODIFICA|CESSAZIONE", "INTRODUZIONE|SOMMARIO|LEGENDA|PROCEDURA|SISTEMA", r"PRIMO\s+ACCESSO|CAMBIO\s+PASSWORD|LISTA\s+ATTIVITÀ", "PROFILAZIONE|TRATTAMENTO|RIEPILOGO"]
CAPTION_WORDS = ["FIGURA", "TABELLA", "STEP"]
NUMBERED_TITLE = r"^\d+(\.\d+)*\.?\s+[A-Z]"
TOC_NUMBER_TITLE_PAGE = r"(\d+(?:\.\d+)*\.?)\s+([A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ][A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ\s]{2,60}?)\s*\.{3,}\s*(\d+)"
TOC_TITLE_PAGE = r"^([A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ][A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ\s]{2,60}?)\s*\.{3,}\s*(\d+)\s*$"
TOC_NUMBER_TITLE = r"(\d+(?:\.\d+)*\.?)\s+([A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ][A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ\s]{2,60}?)(?:\s|$)"
TOC_HEADINGS = ["SOMMARIO", "Sommario", "INDICE", "Indice"]
TOC_SKIP = ["sommario", "indice", "figura", "tabella", "pag."]
TOC_PAGES = 5

# Sizes and limits.
CHUNK_TOKENS, INITIAL_TOP_K, RERANKED_TOP_N, MAX_PATHS, MAX_HOPS, MAX_SHORTEST = 512, 20, 5, 3, 5, 10
ENTITY_BATCH, RELATION_BATCH = 15, 30
METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
