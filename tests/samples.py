"""Recorded answers in miniature, one per service, and the papers in them."""

import json

SAMPLES = {
    "pubmed": '<?xml version="1.0"?><!DOCTYPE PubmedArticleSet><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate><Year>2023</Year><Month>March</Month></PubDate></JournalIssue><Title>J One</Title></Journal><ArticleTitle>Foo <i>bar</i> baz</ArticleTitle><Abstract><AbstractText Label="BACKGROUND">a &amp; b</AbstractText><AbstractText>c</AbstractText></Abstract><AuthorList><Author><LastName>Li</LastName><ForeName>Wei</ForeName></Author><Author><ForeName>X</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/Abc</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>12</PMID></MedlineCitation></PubmedArticle>'
    "<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal><ArticleTitle> Two  words </ArticleTitle><ArticleDate><Year>2020</Year><Month>7</Month><Day>9</Day></ArticleDate></Article></MedlineCitation></PubmedArticle>"
    "<PubmedArticle><MedlineCitation><PMID>14</PMID><Article><Journal><JournalIssue><PubDate><Year>Spring</Year></PubDate></JournalIssue></Journal><ArticleTitle>Dropped</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    "<PubmedArticle><MedlineCitation><PMID>15</PMID><Article><Journal><JournalIssue><PubDate><Year>2018</Year><Month>11</Month></PubDate></JournalIssue></Journal><ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>",
    "arxiv": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A  title</title><summary>Some\n text</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><link href="https://dx.doi.org/10.1/x"/></entry><entry><id> https://arxiv.org/2402.7 </id><title>B</title><published>2023-12-31</published><author><name> </name></author></entry><entry><id>z</id><title>Dropped</title><published>soon</published></entry></feed>',
    "biorxiv": json.dumps({"collection": [{"title": "Genome deep", "abstract": "x", "doi": "2024.01.01.1", "date": "2024-01-05", "authors": "A, B; C, D"}, {"title": "Nothing", "abstract": "y", "doi": "10.1101/z", "date": "2024-02-01", "authors": ""}]}),
    "semantic_scholar": json.dumps({"data": [{"paperId": "p1", "title": "T1", "authors": [{"name": "A"}], "abstract": None, "year": 2021, "venue": "V", "publicationDate": None, "url": "u", "externalIds": {"PubMed": "77"}}, {"paperId": "p2", "title": ""}]}),
    "europepmc": json.dumps({"resultList": {"result": [{"id": "e1", "title": "T2", "pmid": "5", "authorList": {"author": [{"fullName": "F N"}]}, "firstPublicationDate": "2022-03-04", "pubYear": "2022", "abstractText": "abs", "journalTitle": "J"}]}}),
    "crossref": json.dumps({"message": {"items": [{"DOI": "10.2/Q", "title": ["T3"], "author": [{"given": "G", "family": "F"}], "abstract": "<jats:p>q</jats:p>", "container-title": ["C"], "published": {"date-parts": [[2022, 5]]}, "URL": "w"}]}}),
}
FIELDS = ["id", "title", "authors", "abstract", "journal", "year", "date", "doi", "url", "source"]
PAPERS = {
    "pubmed": [
        ('10.1/Abc', 'Foo bar baz', 'Li Wei', 'BACKGROUND: a & b c', 'J One', 2023, '2023-03-01', '10.1/Abc', 'https://doi.org/10.1/Abc', 'pubmed'),
        ('pmid:13', 'Two words', '', '', '', 2020, '2020-07-09', '', 'https://pubmed.ncbi.nlm.nih.gov/13/', 'pubmed'),
        ('pmid:15', 'Plain', '', '', '', 2018, '2018-11-01', '', 'https://pubmed.ncbi.nlm.nih.gov/15/', 'pubmed'),
    ],
    "arxiv": [
        ('https://dx.doi.org/10.1/x', 'A title', 'A B', 'Some text', 'arXiv (preprint)', 2024, '2024-01-02', 'https://dx.doi.org/10.1/x', 'http://arxiv.org/abs/2401.00001v2', 'arxiv'),
        ('arxiv:2402.7', 'B', '', '', 'arXiv (preprint)', 2023, '2023-12-31', '', 'https://arxiv.org/2402.7', 'arxiv'),
    ],
    "biorxiv": [
        ('10.1101/2024.01.01.1', 'Genome deep', 'A, B;C, D', 'x', 'bioRxiv (preprint)', 2024, '2024-01-05', '10.1101/2024.01.01.1', 'https://doi.org/10.1101/2024.01.01.1', 'biorxiv'),
    ],
    "semantic_scholar": [
        ('pmid:77', 'T1', 'A', '', 'V', 2021, '2021-01-01', '', 'u', 'semantic_scholar'),
    ],
    "europepmc": [
        ('pmid:5', 'T2', 'F N', 'abs', 'J', 2022, '2022-03-04', '', 'https://europepmc.org/article/MED/5', 'europepmc'),
    ],
    "crossref": [
        ('10.2/Q', 'T3', 'F G', 'q', 'C', 2022, '2022-05-01', '10.2/Q', 'https://doi.org/10.2/Q', 'crossref'),
    ],
}
