"""Explicit schemas of the text formats."""

GENEPRED = "gene_name string, name string, chrom string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exonCount int, exonStarts string, exonEnds string"
PSL = "matches int, misMatches int, repMatches int, nCount int, qNumInsert int, qBaseInsert int, tNumInsert int, tBaseInsert int, strand string, qName string, qSize int, qStart int, qEnd int, tName string, tSize int, tStart int, tEnd int, blockCount int, blockSizes string, qStarts string, tStarts string"
SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
VCF = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
