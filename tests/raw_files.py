"""Synthetic raw files for the source and workflow tests."""

import json
from pathlib import Path

SEED = """﻿adc_id,adc_name,aliases,target,antibody,linker_name,linker_type,payload_name,payload_class,dar,indication,development_status,company,source_url,data_review_status
e1,Alphamab vedotin,AV-101|Alpha V,HER2,alphamab,mc-vc,cleavable,MMAE,auristatin,4.0,breast cancer,approved,Acme,https://acme.example/av,needs_review
e2,Betamab deruxtecan,BD-202,TROP2,betamab,ggfg,cleavable,DXd,topoisomerase I inhibitor,8.0,,investigational,Beta Inc,,needs_review
e3,Gammamab tesirine,,HER2,,,unknown,,,,lung cancer,unknown,,,reviewed
"""
ENTITIES = {"targets": {"HER2": ["ERBB2", "HER-2"], "TROP2": ["TROP-2", "TACSTD2"]}, "payloads": {"MMAE": ["vedotin"], "DXd": ["deruxtecan"]}}


def study(nct, title, status="RECRUITING", phases=("PHASE2",), interventions=(("Alphamab vedotin", ["AV-101"]),), count=10):
    return {"protocolSection": {
        "identificationModule": {"nctId": nct, "briefTitle": title, "officialTitle": f"Official {title}"},
        "statusModule": {"overallStatus": status, "startDateStruct": {"date": "2023-01"}},
        "designModule": {"phases": list(phases), "enrollmentInfo": {"count": count}},
        "conditionsModule": {"conditions": ["Breast Cancer"]},
        "armsInterventionsModule": {"interventions": [{"name": n, "otherNames": o} for n, o in interventions]},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme"}}, "outcomesModule": {"primaryOutcomes": [{"measure": "Objective response rate"}, {"measure": ""}]}}}


def article(pmid, title, parts, journal="J Test", date="<Year>2024</Year><Month>Mar</Month>", extra=""):
    body = "".join(f'<AbstractText{f" Label={chr(34)}{label}{chr(34)}" if label else ""}>{text}</AbstractText>' for label, text in parts)
    return (f"<PubmedArticle><MedlineCitation><PMID Version=\"1\">{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue>"
            f"<Title>{journal}</Title></Journal><ArticleTitle>{title}</ArticleTitle><Abstract>{body}</Abstract><AuthorList><Author><LastName>Doe</LastName>"
            f"<Initials>J</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData>"
            f"<History>{extra}</History><ArticleIdList><ArticleId IdType=\"pubmed\">{pmid}</ArticleId><ArticleId IdType=\"doi\">10.1/{pmid}</ArticleId></ArticleIdList>"
            f"</PubmedData></PubmedArticle>")


PAGE = """<html><table><tr><th>ADC ID</th><td><div>DRG001</div></td></tr><tr><th>ADC Name</th><td>Alphamab <b>vedotin</b></td></tr>
<tr><th>Drug Status</th><td>Approved (FDA)</td></tr><tr><th>Drug-to-Antibody Ratio</th><td>about 3.5 &plusmn; 0.1</td></tr>
<tr><th>Antigen Name</th><td>Receptor ERBB2 &amp; more</td></tr><tr><th>Synonyms</th><td>AV-101; AV101;<br>Alpha</td></tr>
<tr><th>Drug Status</th><td>Withdrawn</td></tr></table></html>"""


def write_raw(root: Path, second: bool = False) -> str:
    for name in ("trials", "articles", "pages"):
        (root / name).mkdir(parents=True, exist_ok=True)
    (root / "seed.csv").write_text(SEED, encoding="utf-8")
    (root / "entities.json").write_text(json.dumps(ENTITIES), encoding="utf-8")
    first = [study("NCT00000001", "Alphamab vedotin in HER2 breast cancer"), study("NCT00000002", "Betamab", interventions=(("Betamab deruxtecan", []),))]
    page2 = [study("NCT00000002", "Betamab deruxtecan in TROP2 disease", status="COMPLETED" if second else "RECRUITING", phases=("PHASE1", "PHASE2"),
                   interventions=(("Betamab deruxtecan", ["BD-202"]),)), {"protocolSection": {"identificationModule": {"nctId": "NCT00000009"}}}]
    (root / "trials" / "page_1.json").write_text(json.dumps({"totalCount": 2, "nextPageToken": "t", "studies": first}), encoding="utf-8")
    (root / "trials" / "page_2.json").write_text(json.dumps({"totalCount": 2, "studies": page2}), encoding="utf-8")
    xml = "<?xml version=\"1.0\"?><PubmedArticleSet>" + article(
        "101", "Mechanism of <i>Alphamab vedotin</i> &amp; bystander killing",
        [("BACKGROUND", "Alphamab vedotin binds HER2. The payload MMAE is released in cells."), ("RESULTS", "Internalization of the payload was rapid. Bystander killing was seen.")]) + article(
        "102", "Betamab deruxtecan safety", [("", "Neutropenia was the main adverse event of BD-202 in TROP2 tumours.")], date="<MedlineDate>2024 Nov-Dec</MedlineDate>") + "</PubmedArticleSet>"
    (root / "articles" / "set1.xml").write_text(xml, encoding="utf-8")
    (root / "pages" / "e1.html").write_text(PAGE, encoding="utf-8")
    return str(root)
