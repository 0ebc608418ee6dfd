"""A page's hOCR document against one worked out by hand."""

from pageloom.operators import document

WANTED = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN"
    "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">
 <head>
  <title>a&b.png</title>
  <meta http-equiv="Content-Type" content="text/html;charset=utf-8"/>
  <meta name='ocr-system' content='tesseract 5.5.0' />
  <meta name='ocr-capabilities' content='ocr_page ocr_carea ocr_par ocr_line ocrx_word ocrp_dir ocrp_lang ocrp_wconf'/>
 </head>
 <body>
  <div class='ocr_page' id='page_1' title='image "a&amp;b.png"; bbox 0 0 100 80; ppageno 0; scan_res 0 0'>
   <div class='ocr_carea' id='block_1_1' title="bbox 0 5 100 70">
    <p class='ocr_par' id='par_1_1' title="bbox 0 5 100 70">
     <span class='ocr_line' id='line_1_1' title="bbox 0 5 60 20">
      <span class='ocrx_word' id='word_1_1' title='bbox 0 5 20 20; x_wconf 91'>&lt;A&gt;</span>
      <span class='ocrx_word' id='word_1_2' title='bbox 30 6 60 18; x_wconf 40'>it&#39;s</span>
     </span>
     <span class='ocr_line' id='line_1_2' title="bbox 10 50 100 70">
      <span class='ocrx_word' id='word_1_3' title='bbox 10 50 100 70; x_wconf 7'>end</span>
     </span>
    </p>
   </div>
  </div>
 </body>
</html>
"""


def test_document(spark):
    words = spark.createDataFrame(
        [(1, 4, 0, "end", 10, 50, 130, 70, 7), (1, 2, 5, "it's", 30, 6, 60, 18, 40), (1, 2, 1, "<A>", -3, 5, 20, 20, 91)],
        "doc_id long, line_idx int, word_idx int, text string, l int, t int, r int, b int, conf int",
    )
    pages = spark.createDataFrame([(1, "a&b.png", 100, 80), (2, "blank", 30, 40)], "doc_id long, name string, w int, h int")
    got = dict(document.hocr(words, pages).collect())
    assert got[1] == WANTED
    assert got[2].endswith(""" <body>
  <div class='ocr_page' id='page_1' title='image "blank"; bbox 0 0 30 40; ppageno 0; scan_res 0 0'>
  </div>
 </body>
</html>
""")
